"""Filling containers of fixed capacity: best-two-fit over the sizes.

Which documents fill a container depends on their sizes only, and there are at
most ``capacity`` different sizes.  So the plan is made from the table size ->
number of items, which stays small whatever the input: a container is filled
greedily, largest first; then its smallest item gives way to the two unpacked
items that fill the larger gap best, if they fill more.  The pattern found is
repeated as long as every choice in it would be the same, so a plan has a few
patterns for each size.  Items are then numbered within their size (in shards,
so that no size is hot) and looked up in the plan.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import bpe
from loam.session import map_arrow, written

#: Items of a size that one task numbers, about.
SHARD = 100_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(size -> how many of it in a container, number of such containers)], in the order of filling."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    sizes = sorted(left)
    plan = []
    while sizes:
        gap, tried = capacity, Counter()
        at = len(sizes)
        while (at := bisect.bisect_right(sizes, gap, 0, at) - 1) >= 0:
            s = sizes[at]
            m = min(left[s], gap // s)
            tried[s] += m
            gap -= m * s
            # the next smaller size, or none
        final = Counter(tried)
        if gap:
            least = min(tried)
            room = gap + least
            known = np.array(sizes[: bisect.bisect_right(sizes, room)])
            spare = np.array([left[s] - tried[s] for s in known.tolist()])
            known, spare = known[spare > 0], spare[spare > 0]
            if len(known):
                other = np.searchsorted(known, room - known, "right") - 1
                own = np.arange(len(known))
                other = np.where((other == own) & (spare < 2), other - 1, other)
                total = np.where(other >= 0, known + known[np.maximum(other, 0)], -1)
                best = int(np.argmax(total))
                if total[best] > least:
                    final[least] -= 1
                    final[int(known[best])] += 1
                    final[int(known[other[best]])] += 1
                    final = +final
        need = final | tried  # what each repetition must still find
        times = 1 + min((left[s] - need[s]) // n for s, n in final.items())
        for s, n in final.items():
            left[s] -= n * times
            if not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
        plan.append((dict(final), times))
    return plan


def _lookup(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (size, first number, items in a container, first container), sorted."""
    rows, used, container = [], Counter(), 0
    for pattern, times in plan:
        for s, m in pattern.items():
            rows.append((s, used[s], m, container))
            used[s] += m * times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def fill(items: DataFrame, configs: list[tuple[str, int]], key: str, size: str) -> DataFrame:
    """Places each row of ``items`` in a container of every configuration.

    (config, container, key, part, first, n): the tokens [first, first + n) of
    ``key`` lie in the container.  An item above the capacity is cut into full parts
    and a rest; no other is cut.  Items of size 0, null or below need no room and are
    put into container 0.  ``key`` may repeat; equal sizes are placed in no particular
    order of their keys.  No items, no rows.  Reads ``items`` twice.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    given = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(int(cap)).cast("bigint").alias("cap")) for c, cap in configs])
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    parts = (
        items.select(F.col(key), n.alias("total"), F.explode(given).alias("g"))
        .select("g.*", key, "total", F.explode(F.expr("sequence(0L, greatest(0L, (total - 1) div g.cap))")).alias("part"))
        .withColumn("first", F.col("part") * F.col("cap"))
        .withColumn("n", F.least(F.col("cap"), F.col("total") - F.col("first")))
        .drop("cap", "total")
    )
    shards = max(1, -(-items.count() // SHARD))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)))
    groups = parts.where("n > 0").groupBy("config", "n", "shard").agg(F.count(F.lit(1)).alias("there"))
    groups = written(groups)
    caps, tables = dict(configs), {}
    counted: dict[str, dict[int, int]] = {c: {} for c in caps}
    # at most as many rows as there are sizes: the sum of the capacities
    for r in groups.groupBy("config", "n").agg(F.sum("there").alias("there")).collect():
        counted[r.config][r.n] = r.there
    for c, sizes in counted.items():
        tables[c] = _lookup(best_two_fit(sizes, caps[c]))
    shared = spark.sparkContext.broadcast(tables)

    before = Window.partitionBy("config", "n").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("base", F.coalesce(F.sum("there").over(before), F.lit(0))).drop("there")
    within = Window.partitionBy("config", "n", "shard").orderBy(key, "part")
    numbered = (
        parts.withColumn("number", F.row_number().over(within).cast("bigint") - 1)
        .join(starts, ["config", "n", "shard"], "left")
        .select("config", key, "part", "first", "n", (F.col("number") + F.coalesce("base", F.lit(0))).alias("number"))
    )

    def place(batches):
        plans = shared.value
        for b in batches:
            config = np.array(b.column(0).to_pylist(), object)
            sizes, number = b.column(4).to_numpy(), b.column(5).to_numpy()
            out = np.zeros(b.num_rows, np.int64)
            for c in set(config.tolist()):
                own = np.flatnonzero((config == c) & (sizes > 0))
                t = plans[c]
                if len(own):
                    at = np.searchsorted(t[:, 0] * (1 << 40) + t[:, 1], sizes[own] * (1 << 40) + number[own], "right") - 1
                    out[own] = t[at, 3] + (number[own] - t[at, 1]) // t[at, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), *b.columns[1:5]], names=["config", "container", key, "part", "first", "n"])

    return map_arrow(numbered, place, f"config string, container bigint, `{key}` {kind}, part bigint, first bigint, n bigint")


def pack_documents(docs: DataFrame, capacities: DataFrame, key: str, text: str, folder: str | None = None) -> DataFrame:
    """Containers of each row of ``capacities`` (config, capacity_tokens, tokenizer), a table of a few rows."""
    out, by_tokenizer = None, {}
    for r in capacities.dropDuplicates(["config"]).orderBy("config").collect():
        by_tokenizer.setdefault(r.tokenizer, []).append((r.config, r.capacity_tokens))
    for name, configs in sorted(by_tokenizer.items()):
        path = bpe.tokenizer_path(f"{name}.tiktoken", **({"folder": folder} if folder else {}))
        sizes = written(bpe.count_column(docs, key, text, path))
        placed = fill(sizes, configs, key, "n_tokens")
        out = placed if out is None else out.unionByName(placed)
    return out


def container_fill(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(config, containers, tokens, fewest_possible, filled): how well the containers are filled."""
    per = placed.groupBy("config").agg(
        F.countDistinct(F.when(F.col("n") > 0, F.col("container"))).alias("containers"), F.sum("n").alias("tokens")
    )
    cap = F.col("capacity_tokens")
    return per.join(F.broadcast(capacities.select("config", "capacity_tokens")), "config").select(
        "config", "containers", "tokens",
        F.ceil(F.col("tokens") / cap).alias("fewest_possible"),
        (F.col("tokens") / (F.col("containers") * cap)).alias("filled"),
    )
