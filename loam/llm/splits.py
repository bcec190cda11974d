"""Splits that keep related records together.

The documents that a record names are its entities.  Records that share an
entity, directly or through others, form one component; the component's identifier,
hashed, falls into one of the splits' proportional ranges.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.words import INVISIBLE
from loam.operators.components import connected_components
from loam.operators.grouping import with_group_values
from loam.session import map_arrow, written

_RFC = re.compile(r"(?:\brfc|request\s+for\s+comments)[\W_]*0*(\d+)")
_PLACE = re.compile(r"[\s,;(\[]*\b(?:sections?|sec|chapters?|chap|ch|appendix|pages?|pp|part|figure|table)\b\.?\s*[\w.\-]+[\s)\]]*$|\s*§\s*[\w.]+\s*$")
_EXTENSION = re.compile(r"\.(?:pdf|txt|html?|docx?|md|xml|rst|json)$")
_SEVERAL = re.compile(r"\s*;\s*|\s+[/|&+]\s+|\n+")
_VERSION = {"release", "rel", "version", "ver", "v", "r"}


def documents_named(text: str | None) -> list[str]:
    """The documents that a label or a path names: 'rfc:<number>' or 'title:<words>|<release>'.

    Case, spacing, separators, articles, directories, file types, leading zeros and
    sections or chapters make no difference.  Null, blank and placeholder values, and titles
    without a release, name nothing.
    """
    if not text:
        return []
    x = unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower().strip()
    if "/" in (path := x.replace("\\", "/")) and not re.search(r"\s/\s", path) and not re.search(r"\s", path):
        x = path.rsplit("/", 1)[1]
    parts = []
    for p in _SEVERAL.split(x):
        halves = re.split(r"\s+and\s+", p)
        parts += halves if all(re.search(r"\d", h) for h in halves) else [p]
    out = []
    for p in parts:
        if numbers := _RFC.findall(p):
            out += [f"rfc:{n}" for n in numbers]
            continue
        p = _EXTENSION.sub("", p.strip())
        while (q := _PLACE.sub("", p)) != p:
            p = q
        w = [re.sub(r"^v(?=\d+$)", "", t) for t in re.findall(r"[^\W_]+", p)]
        if w[:1] == ["the"]:
            w = w[1:]
        w = [t for i, t in enumerate(w) if not (t in _VERSION and i + 1 < len(w) and w[i + 1].isdigit())]
        cut = len(w)
        while cut and w[cut - 1].isdigit():
            cut -= 1
        if 0 < cut < len(w):
            out.append(f"title:{' '.join(w[:cut])}|{'.'.join(str(int(n)) for n in w[cut:])}")
    return sorted(set(out))


def entities(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, entity): one row for each document that a row names in any of the columns."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            coded = [c.dictionary_encode() for c in b.columns[1:]]  # a label that many rows have is parsed once a batch
            parsed = [([documents_named(x) for x in c.dictionary.to_pylist()], c.indices.to_pylist()) for c in coded]
            lists = [sorted({e for names, at in parsed if at[i] is not None for e in names[at[i]]}) for i in range(b.num_rows)]
            rows = [i for i, x in enumerate(lists) for _ in x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([e for x in lists for e in x], pa.string())], names=[key, "entity"])

    return map_arrow(df.select(key, *columns), run, f"`{key}` {kind}, entity string").distinct()


def groups(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, component): the smallest key of each row's group; a row that names nothing is its own group.

    Rows with a null key are left out; repeated keys count once.  A document
    that a third of all rows name gives one edge a row (to its smallest row).
    """
    named = written(entities(df, key, columns))
    hubs = with_group_values(named.select(F.col(key).alias("a"), "entity"), "entity", "a", b=F.min("a"))  # spreads the rows of a hot entity
    edges = hubs.where("a != b").select("a", "b").distinct()
    found = connected_components(edges).withColumnRenamed("node", key)
    return (
        df.select(key).where(F.col(key).isNotNull()).distinct().join(found, key, "left").select(key, F.coalesce("component", key).alias("component"))
    )


def assign(grouped: DataFrame, key: str, targets: DataFrame, seed: str = "split") -> DataFrame:
    """(key, component, split_name): whole components into splits of about the given proportions.

    ``targets`` is a table of a few rows (split_name, proportion).  A component's identifier and the seed, hashed,
    are a number in [0, 1); the splits, in the order of their names, have ranges of that in proportion.  So
    a component's split depends on nothing but its identifier, whatever its size and whatever else the
    table holds; how far the shares are from the proportions follows from the sizes of components
    (:func:`split_report`).  Without a positive proportion the split is null.
    """
    wanted = [(r.split_name, float(r.proportion)) for r in targets.orderBy("split_name").collect() if r.proportion and r.proportion > 0]
    whole = sum(p for _, p in wanted)
    # 52 bits of SHA-256 as a number in [0, 1)
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    by_range, upto = F.lit(None).cast("string"), 0.0
    for k, (name, p) in enumerate(wanted):
        upto += p / whole
        if k == len(wanted) - 1:
            by_range = F.lit(name) if k == 0 else by_range.otherwise(F.lit(name))
        else:
            by_range = F.when(place < upto, name) if k == 0 else by_range.when(place < upto, name)
    return grouped.select(key, "component", by_range.alias("split_name"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, proportion, records, components, share)."""
    per = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    all_splits = Window.partitionBy()  # over the few rows of the targets
    n = F.coalesce("records", F.lit(0))
    return (
        F.broadcast(targets)
        .join(per, "split_name", "left")
        .select("split_name", "proportion", n.alias("records"), F.coalesce("components", F.lit(0)).alias("components"))
        .withColumn("share", F.try_divide(F.col("records"), F.sum("records").over(all_splits)))
    )
