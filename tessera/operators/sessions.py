"""Summaries of validation sessions, of version comparisons and of benchmark runs: one row each, beside the rows that they are of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.labels import SEVERITIES, ordinal
from tessera.operators.quantiles import percentiles

# The columns of the reports, in order.
VALIDATION_COLUMNS = [
    "track_id", "path", "status", "severity", "mode_severity", "mode_worst_pair", "mode_reasons", "history_severity", "history_worst_mode", "history_reasons", "modes", "convergence", "resolved_genres", "versions",
    "input_quality", "fast_windows", "auto_windows", "accurate_windows", "auto_saved_windows_pct", "notes",
]
VERSION_COLUMNS = ["track_id", "path", "severity", "left_genre", "right_genre", "left_family", "right_family", "tempo_relation", "js_divergence", "cosine_similarity", "topn_weighted_overlap", "reasons"]
BENCHMARK_COLUMNS = ["query_id", "query_type", "precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k", "embedding_seconds", "ranking_seconds", "result_track_ids"]


def percent(part: Column, whole: Column) -> Column:
    """To two decimals; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def session_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts over a session's rows: ``status`` (analyzed, skipped, error or remaining), ``mode_severity`` and ``history_severity``
    (null without a comparison), ``history_comparable``, the verdicts ``fast_genre, auto_genre, accurate_genre`` (null without one), ``auto_windows``,
    ``accurate_windows``, ``input_quality`` and ``duplicates``. Severities that don't occur are counted as 0; no rows give zeros."""
    has = F.col("status") == "analyzed"
    both = lambda a, b: has & F.col(a).isNotNull() & F.col(b).isNotNull()
    windows = has & (F.col("accurate_windows") > 0) & F.col("auto_windows").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(windows, F.col(c))), F.lit(0))
    worst = F.greatest(ordinal("mode_severity", SEVERITIES), ordinal("history_severity", SEVERITIES))
    levels = lambda name, level: [F.count_if(has & (level == i)).alias(f"{name}_{s.lower()}") for i, s in enumerate(SEVERITIES)]
    sums = outcomes.agg(
        F.count("*").alias("scanned_tracks"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_tracks") for s in ("analyzed", "skipped", "error", "remaining")),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicate_paths"),
        *levels("severity", worst),
        F.count_if(has & F.col("mode_severity").isNotNull()).alias("mode_comparison_tracks"),
        *levels("mode", ordinal("mode_severity", SEVERITIES)),
        F.count_if(has & F.col("history_severity").isNotNull()).alias("history_comparison_tracks"),
        F.count_if(has & ~F.col("history_comparable")).alias("history_not_comparable_tracks"),
        *levels("history", ordinal("history_severity", SEVERITIES)),
        *(F.count_if(both(f"{m}_genre", "accurate_genre")).alias(f"{m}_vs_accurate_total") for m in ("auto", "fast")),
        *(F.count_if(both(f"{m}_genre", "accurate_genre") & (F.col(f"{m}_genre") == F.col("accurate_genre"))).alias(f"_{m}_same") for m in ("auto", "fast")),
        total("accurate_windows").alias("accurate_windows_total"),
        total("auto_windows").alias("auto_windows_total"),
        F.count_if(windows & (F.col("auto_windows") < F.col("accurate_windows"))).alias("auto_early_stop_tracks"),
    )
    quality = outcomes.filter(has).groupBy("input_quality").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("input_quality", F.lit("")), "n")))).alias("input_quality_counts"))
    saved = F.greatest(F.col("accurate_windows_total") - F.col("auto_windows_total"), F.lit(0))
    out = sums.withColumns({
        "auto_vs_accurate_match_pct": percent(F.col("_auto_same"), F.col("auto_vs_accurate_total")), "fast_vs_accurate_match_pct": percent(F.col("_fast_same"), F.col("fast_vs_accurate_total")),
        "saved_windows": saved, "saved_windows_pct": percent(saved, F.col("accurate_windows_total")),
    })
    return out.drop("_auto_same", "_fast_same").join(quality)  # one row each


def version_summary(pairs: DataFrame) -> DataFrame:
    """One row over compared tracks (``severity, left_genre, right_genre, left_family, right_family, tempo_relation, js_divergence,
    cosine_similarity``): counts by severity and tempo relation, matches and means."""
    same = lambda x: F.count_if(F.col(f"left_{x}") == F.col(f"right_{x}"))
    n = F.count("*")
    return pairs.agg(
        n.alias("compared_tracks"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES), *(F.count_if(F.col("tempo_relation") == r).alias(f"tempo_{r.replace('-', '_')}") for r in ("same", "half-double", "different")),
        percent(same("genre"), n).alias("genre_match_pct"), percent(same("family"), n).alias("family_match_pct"), F.avg("js_divergence").alias("mean_js_divergence"), F.avg("cosine_similarity").alias("mean_cosine_similarity"),
    )


def benchmark_summary(queries: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """One row over a benchmark's queries: means of precision, recall, reciprocal rank and nDCG, medians and 95th percentiles of the
    seconds of embedding and ranking, and the mean ``overlap`` of ``paired`` queries, if there are any."""
    means = queries.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in ("precision_at_k", "recall_at_k", "ndcg_at_k")), F.avg("reciprocal_rank").alias("mrr"))
    out = means
    for stage in ("embedding", "ranking"):
        times = percentiles(queries.select(F.lit(0).alias("_k"), f"{stage}_seconds"), ["_k"], f"{stage}_seconds", {f"{stage}_p50": 0.5, f"{stage}_p95": 0.95})
        out = out.join(times.drop("_k", "n"), F.lit(True), "left")  # one row each
    overlap = F.lit(None).cast("double").alias("paired_overlap_mean")
    return out.select("*", overlap) if paired is None else out.join(paired.agg(F.avg("overlap").alias("paired_overlap_mean")))


def report_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A report's columns in their order; what is missing is empty."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns))
