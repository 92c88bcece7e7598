"""Queries over profiles. Suppliers stand for tracks: the brands of their line
items are styles, the sizes of the parts choose families, and tags and
verdicts follow from the supplier's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import labels, profiles
from tessera.sources.tables import load

FAMILIES = ["Pop", "Rock", "Electronic", "Jazz", "Blues", "Latin"]
TAGS = ["Rock music", "Male singing", "Electric guitar", "Happy music", "Techno", "Synthesizer", "Singing", "Musical instrument", "Drum kit", "Sad music", "Salsa music", "Chant", "Drum machine", "Speech"]


def _ranked(df: DataFrame, unit: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(F.col("score").desc(), "label"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= most)


def _array(df: DataFrame, unit: str, name: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("rank", "label", "score")))
    return df.groupBy(unit).agg(F.transform(items, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias(name))


def _tags():
    score = lambda i: ((F.col("track") * (i + 3) + i * i) % 50) / 100.0
    return profiles.best_first(F.array(*[F.struct(F.lit(t).alias("label"), score(i).alias("score")) for i, t in enumerate(TAGS)]))


def tracks(spark, d) -> DataFrame:
    """A row for each track with its evidence."""
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("p_size") % len(FAMILIES) + 1).cast("int"))
    parts = load(spark, d, "part").select("p_partkey", F.concat(family, F.lit(labels.SEPARATOR), "p_brand").alias("label"))
    lines = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("track"), "l_partkey", "l_quantity")
    sums = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("track", "label").agg(F.sum("l_quantity").alias("n"))
    by_family = sums.groupBy("track", labels.family_of("label").alias("label")).agg(F.sum("n").alias("n"))
    scored = lambda df: df.withColumn("score", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("track")), 6))
    styles = _array(_ranked(scored(sums), "track", 12), "track", "styles")
    out = styles.join(_array(_ranked(scored(by_family), "track", 6), "track", "families"), "track")
    n = F.col("track")
    at = lambda array, i: F.get(F.col(array), i)["label"]
    return out.withColumns(
        {
            "tags": _tags(),
            "resolved": profiles.leaf_of(F.get(F.col("styles"), (n % 3).cast("int"))["label"]),
            "confidence": F.element_at(F.array(*[F.lit(c) for c in ("high", "medium", "low-medium", "medium", "low")]), (n % 5 + 1).cast("int")),
            "primary_family": at("families", 0),
            "secondary_family": at("families", 1),
            "secondary_style": F.when(n % 4 != 0, profiles.leaf_of(at("styles", 3))),
            "bpm": F.when(n % 6 != 0, 60 + n % 90 + 0.25).cast("double"),
            "key": F.when(n % 7 != 0, F.element_at(F.array(F.lit("C"), F.lit("F#"), F.lit("A")), (n % 3 + 1).cast("int"))),
            "mode": F.when(n % 2 == 0, "minor"),
        }
    )


def tag_groups(spark, d):
    """The tags of each group, with their place in it."""
    rows = tracks(spark, d).select("track", *[profiles.tag_group(F.col("tags"), g).alias(g) for g in profiles.GROUPS])
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("kind"), F.col(g).alias("tags")) for g in profiles.GROUPS])).alias("x")
    return rows.select("track", pairs).select("track", "x.kind", F.posexplode("x.tags").alias("place", "tag")).select("track", "kind", "place", "tag.label", "tag.score")


def semantic_families(spark, d):
    """Families by tags alone, and how the tags agree with the styles."""
    rows = tracks(spark, d)
    rows = profiles.with_families(rows.withColumn("genre_tags", profiles.tag_group(F.col("tags"), "genre")))
    return rows.select("track", "agreement", F.posexplode("evidence").alias("place", "x")).select("track", "agreement", "place", "x.label", F.round(F.col("x.score") + 1e-7, 3).alias("score"))


def profile_rows(spark, d):
    """The profile of each track."""
    out = profiles.assemble(tracks(spark, d))
    lists = {c: F.array_join(c, "; ") for c in ("adjacent", "moods", "instruments", "production")}
    names = ("broad_family", "primary_style", "secondary", "profile_confidence", "agreement", "adjacent", "moods", "vocal", "instruments", "production", "distributor_genre", "distributor_subgenre", "style_prompt")
    return out.select("track", *[lists.get(c, F.col(c)).alias(c) for c in names])


QUERIES = {f.__name__: f for f in (tag_groups, semantic_families, profile_rows)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_GROUP = lambda g: f"list_filter(tags, lambda t: list_contains({_list(profiles.GROUPS[g][0])}, lower(t.label)) AND t.score >= 0.03::DOUBLE)[:{profiles.GROUPS[g][1]}]"
_TAG_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS label, {i} AS i" for i, t in enumerate(TAGS))
_TRACKS = f"""sums AS (
  SELECT l_suppkey AS track, {_list(FAMILIES)}[p_size % 6 + 1] || '---' || p_brand AS label, sum(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), st AS (
  SELECT track, label, round(n / sum(n) OVER (PARTITION BY track), 6) AS score FROM sums
), fm AS (
  SELECT track, label, round(n / sum(n) OVER (PARTITION BY track), 6) AS score FROM (SELECT track, split_part(label, '---', 1) AS label, sum(n) AS n FROM sums GROUP BY ALL)
), styles AS (
  SELECT track, list({{'label': label, 'score': score}} ORDER BY score DESC, label)[:12] AS styles FROM st GROUP BY track
), families AS (
  SELECT track, list({{'label': label, 'score': score}} ORDER BY score DESC, label)[:6] AS families FROM fm GROUP BY track
), tg AS (
  SELECT track, list({{'label': label, 'score': score}} ORDER BY score DESC, label) AS tags
  FROM (SELECT track, label, ((track * (i + 3) + i * i) % 50) / 100.0::DOUBLE AS score FROM styles, ({_TAG_ROWS})) GROUP BY track
), tracks AS (
  SELECT track, styles, families, tags, split_part(styles[track % 3 + 1].label, '---', 2) AS resolved,
         ['high', 'medium', 'low-medium', 'medium', 'low'][track % 5 + 1] AS confidence, families[1].label AS primary_family, families[2].label AS secondary_family,
         CASE WHEN track % 4 <> 0 THEN split_part(styles[4].label, '---', 2) END AS secondary_style, CASE WHEN track % 6 <> 0 THEN 60 + track % 90 + 0.25 END AS bpm,
         CASE WHEN track % 7 <> 0 THEN ['C', 'F#', 'A'][track % 3 + 1] END AS key, CASE WHEN track % 2 = 0 THEN 'minor' END AS mode
  FROM styles JOIN families USING (track) JOIN tg USING (track)
)"""
_FAMILY_OF = "CASE lower(label) " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in profiles.TAG_FAMILIES.items()) + " END"
_FUSED = f"""g AS (
  SELECT track, {_FAMILY_OF} AS label, score FROM (SELECT track, unnest(tags, recursive := true) FROM (SELECT track, {_GROUP("genre")} AS tags FROM tracks))
), gf AS (
  SELECT track, label, sum(score) AS score FROM g WHERE label IS NOT NULL GROUP BY ALL
), gt AS (
  SELECT track, sum(score) AS total, arg_max(label, (score, -ascii(label))) AS top FROM gf GROUP BY track
), bf AS (
  SELECT track, label, score / sum(score) OVER (PARTITION BY track) AS share FROM (SELECT track, unnest(families, recursive := true) FROM tracks)
), ev AS (
  SELECT b.track, b.label, round((1 - 0.25::DOUBLE * least(1, gt.total)) * b.share + 0.25::DOUBLE * least(1, gt.total) * round(coalesce(gf.score, 0) / gt.total, 6), 12) AS score
  FROM (SELECT track, label, share FROM bf UNION ALL SELECT track, label, 0 FROM gf ANTI JOIN bf USING (track, label)) b JOIN gt USING (track) LEFT JOIN gf USING (track, label)
  UNION ALL SELECT track, label, share FROM bf ANTI JOIN gt USING (track)
), fused AS (
  SELECT t.track, CASE WHEN gt.total IS NULL THEN 'maest_only' WHEN gt.top = primary_family THEN 'agree' ELSE 'mixed' END AS agreement, e.evidence
  FROM tracks t LEFT JOIN gt USING (track) JOIN (SELECT track, list({{'label': label, 'score': score}} ORDER BY score DESC, label) AS evidence FROM ev GROUP BY track) e USING (track)
)"""
_UNIQUE = lambda g, n: f"list_transform({_GROUP(g)}, lambda t: t.label)[:{n}]"
SQL = {
    "tag_groups": f"WITH {_TRACKS} SELECT track, kind, (place - 1)::INT AS place, tags[place].label AS label, tags[place].score AS score FROM ("
    + " UNION ALL ".join(f"SELECT track, '{g}' AS kind, {_GROUP(g)} AS tags, unnest(range(1, len({_GROUP(g)}) + 1)) AS place FROM tracks" for g in profiles.GROUPS)
    + ")",
    "semantic_families": f"WITH {_TRACKS}, {_FUSED} SELECT track, agreement, (place - 1)::INT AS place, evidence[place].label AS label, round(round(evidence[place].score, 6) + 1e-7::DOUBLE, 3) AS score FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS place FROM fused)",
    "profile_rows": f"""WITH {_TRACKS}, {_FUSED}, a AS (
  SELECT t.*, agreement, CASE WHEN confidence <> 'high' THEN evidence[1].label ELSE primary_family END AS wanted,
         split_part(list_filter(styles, lambda s: split_part(s.label, '---', 2) = resolved)[1].label, '---', 1) AS stated FROM tracks t JOIN fused USING (track)
), b AS (
  SELECT *, split_part(list_filter(styles, lambda s: split_part(s.label, '---', 1) = wanted)[1].label, '---', 2) AS best, coalesce(wanted <> stated, false) AS clash FROM a
), c AS (
  SELECT *, CASE WHEN clash AND best IS NULL THEN stated ELSE wanted END AS broad_family, CASE WHEN (clash OR wanted <> primary_family) AND best IS NOT NULL THEN best ELSE resolved END AS primary_style FROM b
), e AS (
  SELECT *, CASE WHEN primary_style <> resolved OR broad_family <> primary_family THEN resolved ELSE coalesce(secondary_style, secondary_family) END AS secondary FROM c
), f AS (
  SELECT *, list_filter(list_transform(styles, lambda s: split_part(s.label, '---', 2)), lambda x: x <> primary_style AND x <> secondary) AS leaves,
         {_UNIQUE("mood", 3)} AS moods, {_UNIQUE("production", 3)} AS production,
         list_filter(list_transform({_GROUP("instrument")}, lambda t: t.label), lambda x: x <> 'Musical instrument')[:4] AS instruments,
         coalesce(list_filter({_GROUP("vocal")}, lambda t: list_contains({_list(profiles.SPECIFIC_VOCALS)}, lower(t.label)))[1].label, ({_GROUP("vocal")})[1].label) AS vocal FROM e
)
SELECT track, broad_family, primary_style, secondary, CASE WHEN agreement <> 'mixed' THEN confidence WHEN confidence = 'high' THEN 'medium' WHEN confidence = 'medium' THEN 'low-medium' ELSE confidence END AS profile_confidence, agreement,
  array_to_string(list_filter(leaves, lambda x, i: list_position(leaves, x) = i)[:4], '; ') AS adjacent, array_to_string(moods, '; ') AS moods, vocal, array_to_string(instruments, '; ') AS instruments, array_to_string(production, '; ') AS production,
  broad_family AS distributor_genre, CASE WHEN primary_style <> broad_family THEN primary_style END AS distributor_subgenre,
  concat_ws(', ', primary_style, CASE WHEN lower(secondary) <> lower(primary_style) THEN secondary || ' influence' END, nullif(array_to_string(moods[:2], ', '), ''), vocal, nullif(array_to_string(instruments[:3], ', '), ''),
    floor(bpm)::INT || ' BPM', nullif(concat_ws(' ', key, CASE WHEN key IS NOT NULL THEN mode END), '')) AS style_prompt FROM f""",
}
