"""Texts that contain one of a table's fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of fragments is broadcast and every text searched for all of them.
SMALL = 1000


def containing(texts: DataFrame, text: str, fragments: DataFrame, fragment: str, small: int = SMALL) -> DataFrame:
    """(text, fragment): each distinct text with each distinct fragment that it contains.

    Up to ``small`` fragments are broadcast.  Beyond that, texts are cut into their substrings of
    the lengths that fragments have, and joined by equality.  Null and empty fragments match nothing.
    """
    left, right = texts.select(text).where(F.col(text).isNotNull()).distinct(), fragments.select(fragment).where(F.col(fragment) != "").distinct()
    if right.limit(small + 1).count() <= small:
        return left.join(F.broadcast(right), F.contains(F.col(text), F.col(fragment)))
    lengths = [r.n for r in right.select(F.length(fragment).alias("n")).distinct().collect()]  # no more than the longest fragment has characters
    cut = left.select(text, F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("_n")).where(F.length(text) >= F.col("_n"))
    cut = cut.select(text, F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1), lambda i: F.substr(F.col(text), i, F.col("_n")))).alias(fragment))
    return cut.distinct().join(right, fragment).select(text, fragment)


def only_fragment(rows: DataFrame, key: str, text: str, fragments: DataFrame, fragment: str) -> DataFrame:
    """(key, fragment): rows whose text contains exactly one fragment; none or several give no row."""
    found = containing(rows, text, fragments, fragment)
    one = found.groupBy(text).agg(F.count(F.lit(1)).alias("_n"), F.min(fragment).alias(fragment)).where("_n = 1").drop("_n")
    return rows.select(key, text).join(one, text).select(key, fragment)


def only_text(fragments: DataFrame, key: str, fragment: str, texts: DataFrame, text: str) -> DataFrame:
    """(key, text): rows whose fragment exactly one distinct text contains; none or several give no row."""
    found = containing(texts, text, fragments, fragment)
    one = found.groupBy(fragment).agg(F.count(F.lit(1)).alias("_n"), F.min(text).alias(text)).where("_n = 1").drop("_n")
    return fragments.select(key, fragment).join(one, fragment).select(key, text)
