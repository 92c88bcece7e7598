"""Files in and out: results as JSON, suites, presets, telemetry, vectors, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("wav", "flac", "mp3", "ogg", "m4a", "aiff")  # Fixed values: file name endings, in any case
RESULT = "path string, analyzed_at string, analyzer_version string, analysis_mode string, confidence string, classification string, resolved_genre string, audio_features struct<bpm: double, key: string, mode: string>, top_styles array<struct<label: string, score: double>>, broad_genres array<struct<label: string, score: double>>"
SUITE = "schema_version int, name string, queries array<struct<query_id: string, query_type: string, text: string, language: string, audio_path: string, paired_query_id: string, relevance: map<string, int>>>"


def audio_files(spark: SparkSession, folder: str, pruned: Sequence[str] = (".git", "__pycache__", ".venv", "node_modules")) -> DataFrame:
    """Paths, sizes and times of audio files below a folder, without service folders; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*pruned))
    return files.filter(F.lower(F.element_at(F.split("path", "\\."), -1)).isin(*AUDIO) & ~inside)


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``path, track_id``: files by the hash of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("track_id"))


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Result files, one JSON object each: the good ones with a run id from
    their path, and the paths of those that aren't results. No file stops the rest."""
    rows = spark.read.schema(RESULT + ", broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    good = F.col("broken").isNull() & F.col("audio_features").isNotNull()
    return rows.filter(good).drop("broken").withColumn("run_id", F.sha2("file", 256)), rows.filter(~good).select("file")


def suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The queries of a benchmark suite, and their grades (``query_id, id, grade``, 0 to 3)."""
    queries = spark.read.schema(SUITE).option("multiLine", "true").json(path).select(F.explode("queries").alias("q")).select("q.*")
    grades = queries.select("query_id", F.explode("relevance").alias("id", "grade")).filter("grade BETWEEN 0 AND 3")
    return queries.drop("relevance"), grades


def parameters(spark: SparkSession, path: str, row_tag: str = "Param") -> DataFrame:
    """``element, param, value`` of an XML preset whose tags carry them as attributes."""
    schema = "_ElementID string, _ParamID string, _Value string"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select(F.col("_ElementID").alias("element"), F.col("_ParamID").alias("param"), F.col("_Value").alias("value"))


def telemetry(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV of numbers where N/A and the like are null."""
    raw = spark.read.option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return raw.select(*[F.regexp_replace(c, "[^0-9eE.+-]", "").try_cast("double").alias(c) for c in columns])


def float_array(column: str | Column) -> Column:
    """The members of little-endian 32-bit floats in base64, by their bits."""
    raw = F.unbase64(column)
    word = lambda i: sum(F.conv(F.hex(F.substring(raw, i * 4 + k + 1, 1)), 16, 10).cast("long") * F.lit(1 << (8 * k)) for k in range(4))

    def value(w: Column) -> Column:
        sign = F.when(F.shiftright(w, 31) % 2 == 1, -1.0).otherwise(1.0)
        exponent = F.shiftright(w, 23) % 256
        fraction = (w % (1 << 23)).cast("double") / (1 << 23)
        normal = sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 127)
        return F.when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-126))).when(exponent == 255, F.lit(None)).otherwise(normal)

    n = F.floor(F.length(raw) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: value(word(i)))).otherwise(F.array().cast("array<double>"))


def flat(df: DataFrame, joined: str = "; ") -> DataFrame:
    """Lists as joined text, so that a table fits into CSV."""
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), joined).alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, joined: str = "; ") -> None:
    flat(df, joined).write.option("header", "true").mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def wav_header(content: str | Column) -> Column:
    """``rate, channels, bits, seconds, kbps`` from the header of PCM WAV bytes; null for other files."""
    head = F.substring(_bytes(content), 1, 4096)
    text = F.decode(head, "ISO-8859-1")

    def number(at: Column, size: int) -> Column:
        return sum(F.ascii(F.substr(text, at + i, F.lit(1))).cast("long") * F.lit(1 << (8 * i)) for i in range(size))

    fmt, data = F.locate("fmt ", text), F.locate("data", text)
    channels, rate, bits, size = number(fmt + 10, 2), number(fmt + 12, 4), number(fmt + 22, 2), number(data + 4, 4)
    good = (F.substring(text, 1, 4) == "RIFF") & (fmt > 0) & (data > 0)
    own = F.struct(rate.alias("rate"), channels.cast("int").alias("channels"), bits.cast("int").alias("bits"), F.try_divide(size, rate * channels * bits / 8).alias("seconds"), (rate * channels * bits / 1000.0).alias("kbps"))
    return F.when(good, own)


def _bytes(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chain_names(data: str | Column) -> Column:
    """The names of a chain: base64 of records of a zero byte, a length of four bytes (least first) and
    a name. A null member stands where the bytes don't go on so."""

    @F.pandas_udf("array<string>")
    def names(chains: pd.Series) -> pd.Series:
        def read(raw: bytes | None) -> list[str | None] | None:
            if raw is None:
                return None
            out, at = [], 0
            while at < len(raw):
                end = at + 5 + int.from_bytes(raw[at + 1 : at + 5], "little")
                if raw[at] or end > len(raw) or end == at + 5:
                    return [*out, None]
                out.append(raw[at + 5 : end].decode("utf-8", "replace"))
                at = end
            return out

        return chains.map(read)

    return names(F.unbase64(_bytes(data)))


def chain_of(names: str | Column) -> Column:
    """The chain of some names, as base64."""

    def record(name: Column) -> Column:
        size = F.lpad(F.hex(F.octet_length(name).cast("long")), 8, "0")
        return F.concat(F.lit("00"), *[F.substring(size, i, 2) for i in (7, 5, 3, 1)], F.hex(F.encode(name, "UTF-8")))

    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(_bytes(names), record), ""))), "\\s", "")


def patch_map(text: str | Column) -> Column:
    """``element, param, value`` of a JSON object of objects, as an array."""
    outer = F.map_entries(F.from_json(_bytes(text), "map<string,map<string,string>>"))
    return F.flatten(F.transform(outer, lambda e: F.transform(F.map_entries(e["value"]), lambda p: F.struct(e["key"].alias("element"), p["key"].alias("param"), p["value"].alias("value")))))


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each, such as registries and states, with their file names."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))


def violations(value: Column, schema: dict, path: str = "$") -> Column:
    """What breaks a contract in a JSON text, as an array of ``path: reason``: type, enum, required, further
    properties, items, least length, least and greatest number. A schema is a plan of expressions, not of rows."""
    found = []
    kind = F.schema_of_variant(F.try_parse_json(value))
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    types = {"object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "integer": kind == "BIGINT", "number": is_number}

    def when(broken: Column, why: str) -> None:
        found.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(f"{path}: {why}")))

    if "type" in schema:
        when(kind.isNull() | ~types[schema["type"]], f"is no {schema['type']}")
    if "enum" in schema:
        when(~value.isin([json.dumps(v) for v in schema["enum"]]), "is none of its values")
    keys = F.when(types["object"], F.json_object_keys(value))
    for key in schema.get("required", []):
        when(~F.array_contains(keys, key), f"lacks {key}")
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in properties]))) > 0, "has further properties")
    text = F.when(types["string"], F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])
    if "minLength" in schema:
        when(F.length(text) < schema["minLength"], f"is shorter than {schema['minLength']}")
    number = F.when(is_number, value.try_cast("double"))
    if "minimum" in schema:
        when(number < schema["minimum"], f"is below {schema['minimum']}")
    if "maximum" in schema:
        when(number > schema["maximum"], f"is above {schema['maximum']}")
    own = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    parsed = F.from_json(F.when(types["object"], value), "map<string,string>")
    for key, child in properties.items():
        # Strings lose their quotes in a map: they get them back, so that a child is JSON text again.
        raw = F.when(F.array_contains(keys, key), F.coalesce(parsed[key], F.lit("null")))
        quoted = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), f"$.{key}", "variant")) == "STRING", F.concat(F.lit('"'), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(raw)
        own = F.concat(own, F.when(raw.isNotNull(), violations(quoted, child, f"{path}.{key}")).otherwise(F.array().cast("array<string>")))
    return own


def named_results(spark: SparkSession, folder: str, pattern: str = "*.genre*.json") -> DataFrame:
    """Result files by name below a folder, each path once whatever its case."""
    files = spark.read.schema(RESULT).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(folder)
    return files.withColumn("file", F.col("_metadata.file_path")).withColumn("_key", F.lower("file")).dropDuplicates(["_key"]).drop("_key")


def tracks_of(contents: DataFrame) -> DataFrame:
    """``track_id, path, others`` from ``path, track_id``: the first path of each content, and the rest in order."""
    paths = contents.groupBy("track_id").agg(F.array_sort(F.collect_set("path")).alias("_paths"))
    return paths.select("track_id", F.get("_paths", 0).alias("path"), F.slice("_paths", 2, F.greatest(F.size("_paths") - 1, F.lit(0))).alias("others"))


def unique_parameters(rows: DataFrame) -> DataFrame:
    """Parameters of a preset, refused if one is given twice."""
    several = rows.groupBy("element", "param").count().filter("count > 1").orderBy("element", "param").limit(5).collect()
    if several:
        raise ValueError(f"given more than once: {[(r.element, r.param) for r in several]}")
    return rows


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows of an older or newer schema with all columns of ``defaults``; what is missing or null has its default."""
    have = set(rows.columns)
    return rows.withColumns({name: F.coalesce(F.col(name), value) if name in have else value for name, value in defaults.items()})


def selected(rows: DataFrame, order: Sequence[str], ids: DataFrame | None = None, id_col: str = "track_id", most: int | None = None) -> DataFrame:
    """The rows of some ids, at most the first ``most`` in order."""
    if ids is not None:
        rows = rows.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return rows if most is None else rows.orderBy(*order).limit(most)
