"""Several tables that change together: a folder of versions with one manifest each.

A write first makes new folders for the tables that change, which no reader knows of, then one manifest that names the
folder of every table. Manifests are numbered; a number is taken by renaming a finished file to it,
which fails if the number is there. So a reader sees all tables of a version or those of the one before,
a write that dies between tables changes nothing, and of two writers that start from one version the second is refused.
The folder needs a file system whose rename is atomic and doesn't replace, such as HDFS or a local disk.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.latest import latest, upsert


class Conflict(Exception):
    """Another write took the version's number."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def number(self) -> int:
        """The last version's number; 0 before the first."""
        if not self.fs.exists(self._path("_versions")):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("_versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def tables(self, number: int | None = None) -> dict[str, str]:
        """The folder of each table in a version, the last by default."""
        number = self.number() if number is None else number
        if not number:
            return {}
        stream = self.fs.open(self._path(f"_versions/{number:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["tables"]

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        path = self.tables(number).get(name)
        return None if path is None else self.spark.read.parquet(f"{self.folder}/{path}")

    def commit(self, changed: Mapping[str, DataFrame], base: int) -> int:
        """The number of a new version in which these tables are changed and the others are as in ``base``, the version that the
        changes were made from."""
        tables = self.tables(base)
        for name, df in changed.items():
            tables[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{tables[name]}")
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"tables": tables}, sort_keys=True).encode()))
        out.close()
        self.fs.mkdirs(self._path("_versions"))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.conf)
        no_options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"_versions/{base + 1:012d}.json"), no_options)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.number() > base:
                raise Conflict(f"version {base + 1} is there") from e
            raise
        return base + 1


#: The keys of the tables of a run, and of those that hang on one.
RUN_TABLES = {"tracks": ["track_id"], "locations": ["track_id", "path"], "runs": ["run_id"]}
CHILDREN = ("styles", "tags", "families")


def record_runs(store: Versions, new: Mapping[str, DataFrame]) -> int:
    """Writes runs with all that belongs to them as one version: tracks, locations and runs replace those of their keys by the greatest
    ``seq``; styles, tags and families replace all rows of the runs that are written, with a rank by score from 1."""
    base, changed = store.number(), {}
    for name, keys in RUN_TABLES.items():
        if name in new:
            old = store.read(name, base)
            changed[name] = latest(new[name], keys, ["seq"]).drop("rn") if old is None else upsert(old, new[name], keys, ["seq"])
    for name in CHILDREN:
        if name in new:
            rows = ranked(new[name])
            old = store.read(name, base)
            runs = new["runs"].select("run_id").distinct()
            changed[name] = rows if old is None else old.join(runs, "run_id", "left_anti").unionByName(rows)
    return store.commit(changed, base)


def ranked(rows: DataFrame) -> DataFrame:
    """``run_id, label, score, rank``: by score, then by label."""
    order = Window.partitionBy("run_id").orderBy(F.col("score").desc(), "label")
    return rows.select("run_id", "label", "score", F.row_number().over(order).alias("rank"))
