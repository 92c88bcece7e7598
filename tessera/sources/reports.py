"""Reports out: a summary row and its rows as JSON and CSV, wide rows of runs,
hits, and short tables in Markdown. Files are folders, as Spark writes them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import safe_token
from tessera.operators import sessions
from tessera.sources.files import flat

MARK = "﻿"  # tells spreadsheets that a CSV is UTF-8


def write_report(summary: DataFrame, rows: DataFrame, path: str, joined: str = "; ") -> None:
    """``summary`` as JSON, ``rows`` as JSON and as CSV with lists joined. A header alone is written for no rows."""
    summary.write.mode("overwrite").json(f"{path}/summary.json")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows.json")
    flat(rows, joined).write.mode("overwrite").option("header", "true").csv(f"{path}/rows.csv")


def report_name(kind: str, *parts: str) -> str:
    """The name of a report's folder: its kind and what is safe of its parts."""
    return ".".join([kind, *(re.sub(r"[^\w.-]", "_", p) for p in parts)])


def write_validation(rows: DataFrame, outcomes: DataFrame, folder: str, session: str) -> str:
    """The report of a session: its summary and its tracks."""
    path = f"{folder}/{report_name('validation', session.replace('-', '')[:8])}"
    write_report(sessions.session_summary(outcomes).withColumn("session_id", F.lit(session)), sessions.report_rows(rows, sessions.VALIDATION_COLUMNS), path)
    return path


def write_version_comparison(rows: DataFrame, folder: str, left: str, right: str, mode: str = "all") -> str:
    """The report of two versions: their summary and the compared tracks."""
    path = f"{folder}/{report_name('version_compare', f'{left}_vs_{right}', mode)}"
    summary = sessions.version_summary(rows).withColumns({"version_a": F.lit(left), "version_b": F.lit(right), "mode": F.lit(mode)})
    write_report(summary, sessions.report_rows(rows, sessions.VERSION_COLUMNS), path)
    return path


def write_benchmark(queries: DataFrame, folder: str, suite: str, backend: str, top_k: int, paired: DataFrame | None = None) -> str:
    """The report of a benchmark as JSON, CSV and Markdown, ``summary.md`` in a folder of one text file."""
    path = f"{folder}/{report_name('benchmark', suite)}"
    summary = sessions.benchmark_summary(queries, paired).withColumns({"suite_name": F.lit(suite), "backend_fingerprint": F.lit(backend), "top_k": F.lit(top_k)})
    write_report(summary, sessions.report_rows(queries, sessions.BENCHMARK_COLUMNS), path, "|")
    measures = [c for c in summary.columns if c not in ("suite_name", "backend_fingerprint", "top_k")]
    lines = summary.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.6f", F.col(c).cast("double"))).alias("value")) for c in measures))).alias("m")).select("m.*")
    head = f"# Retrieval benchmark: {suite}\n\nBackend: `{backend}`, results a query: {top_k}\n\n"
    text = head + markdown(lines) + "\nWhat these numbers say depends on reviewed relevance labels.\n"
    queries.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.md")
    return path


def write_runs(runs: DataFrame, path: str, name: str = "path", run: str = "run_id") -> None:
    """A folder of JSON for each run, named by what is safe of its file's name and its id."""
    token = F.concat_ws(".", safe_token(F.element_at(F.split(name, "[/\\\\]"), -1)), F.left(run, F.lit(8)))
    runs.withColumn("_file", token).write.mode("overwrite").partitionBy("_file").json(path)


def marked(rows: DataFrame, joined: str = "; ") -> DataFrame:
    """``line``: rows as the lines of a CSV with a byte order mark and a header, for writing as text in one file."""
    table = flat(rows, joined)
    quote = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = table.select(F.monotonically_increasing_id().alias("at"), F.concat_ws(",", *[quote(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in table.columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(-1, MARK + ",".join(table.columns))], "at long, line string")
    return head.union(body)


def wide_summary(runs: DataFrame, lists: Sequence[str], fields: Sequence[str], top: int = 3) -> DataFrame:
    """A row for each run: ``fields``, and of each list of scores its labels joined and the first ``top`` as columns."""
    best = lambda c, i: [F.get(F.col(c), i)["label"].alias(f"{c}_{i + 1}"), F.round(F.get(F.col(c), i)["score"], 6).alias(f"{c}_{i + 1}_score")]
    joined = [F.array_join(F.transform(c, lambda x: F.concat(x["label"], F.lit("="), F.format_string("%.4f", x["score"]))), "; ").alias(f"{c}_all") for c in lists]
    return runs.select(*fields, *[x for c in lists for i in range(top) for x in best(c, i)], *joined)


def hit_rows(hits: DataFrame, similarity: str = "similarity", joined: str = " | ") -> DataFrame:
    """Hits for a CSV: nine decimals of similarity, lists joined."""
    return flat(hits, joined).withColumn(similarity, F.format_string("%.9f", F.col(similarity)))


def same_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of different columns under one header, in the order in which they first appear."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows; a longer one is refused, as it would pass whole through the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, found)]) + "\n"


def log_line(event: str, **fields: Column) -> Column:
    """An event as a line of JSON, to be appended as text and read back by the stream of the log."""
    return F.to_json(F.struct(F.lit(event).alias("event"), *[c.alias(k) for k, c in fields.items()]))
