"""What the corpus operators share: reading tables, words and hashes as SQL
expressions, and tables written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import written
from tessera.sources.tables import load, spread

__all__ = ["NOT_SPACE", "SPACE", "digest", "table", "text_of", "uncovered", "words", "written"]

#: The white space that separates words, as a Java and RE2 character class.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(load(spark, sf_dir, name))


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't white space."""
    return F.array_remove(F.split(text, SPACE), "")


def digest(text: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(text))


def uncovered(lines: Column, starts: Column, span: int) -> Column:
    """``lines`` without those that windows of ``span`` at the sorted
    ``starts`` cover; in time linear in the lines."""

    def pieces(lines: Column, starts: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1) + span)
        end = lambda i: F.coalesce(F.get(starts, i), F.size(lines))
        return F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.slice(lines, begin(i) + 1, F.greatest(end(i) - begin(i), F.lit(0))))

    # Bound to a variable both are computed once, not for each piece.
    once = F.array(F.struct(lines.alias("lines"), starts.alias("starts")))
    return F.get(F.transform(once, lambda x: F.flatten(pieces(x["lines"], x["starts"]))), 0)
