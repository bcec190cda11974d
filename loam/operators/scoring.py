"""Scores of generated responses, comparisons of two stages, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.matching import only_fragment


def phrase(c: Column) -> Column:
    """Words joined by one blank."""
    return F.array_join(T.words(c), " ")


def concept_matches(concept: Column, response: Column) -> Column:
    """Whether a concept - or an alternative joined by 'or' - stands in a response as whole words; up to five characters also run together.

    ``response`` is a :func:`phrase`.
    """
    alternatives = F.transform(F.split(concept, r"(?i)[ \t\n]+or[ \t\n]+"), phrase)
    padded = F.concat(F.lit(" "), response, F.lit(" "))
    dense = F.replace(response, F.lit(" "), F.lit(""))

    def one(a):
        short = F.replace(a, F.lit(" "), F.lit(""))
        return (a != "") & (padded.contains(F.concat(F.lit(" "), a, F.lit(" "))) | ((F.length(short) <= 5) & dense.contains(short)))

    return F.exists(alternatives, one)


def concept_hits(concepts: Column, response: Column) -> Column:
    """How many concepts match; null concepts count as none."""
    return T.let(phrase(response), lambda r: F.size(F.filter(F.coalesce(concepts, F.array().cast("array<string>")), lambda c: concept_matches(c, r))))


def whole_word_hits(concepts: Column, response: Column) -> Column:
    """The second reading: the concept's words, any white space between, not within longer words."""
    x = F.lower(T.squeeze(F.coalesce(response, F.lit(""))))

    def one(c):
        body = T.sub(T.sub(F.lower(T.squeeze(c)), r"([\\.\[\](){}+*?^$|\-])", r"\\$1"), " ", r"\\s+")
        return F.regexp_like(x, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), body, F.lit(r"(?![\p{L}\p{N}_])")))

    return F.size(F.filter(F.coalesce(concepts, F.array().cast("array<string>")), one))


def common_prefix_ratio(response: Column, expected: Column) -> Column:
    """Equal words at the beginning, as a share of the expected words; 0 without expected words."""

    def share(r, e):
        same = F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i < F.size(r)) & (F.get(r, i) == F.get(e, i)))
        first = F.array_position(F.transform(same, lambda v: F.coalesce(v, F.lit(False))), F.lit(False)).cast("int")
        return F.when(F.size(e) == 0, F.lit(0.0)).otherwise(F.when(first == 0, F.size(e)).otherwise(first - 1) / F.size(e))

    return T.let(T.words(response), lambda r: T.let(T.words(expected), lambda e: F.when(F.size(e) == 0, F.lit(0.0)).otherwise(share(r, e))))


#: Product of two arrays' sizes up to which their words are counted one by one.
PRODUCT = 10_000


def overlap(a: Column, b: Column) -> Column:
    """The size of the intersection of two arrays as bags.

    Short arrays are counted word by word; the effort of that is the product of their sizes, so long ones are sorted
    together and folded once over the runs of equal words.
    """
    count = lambda x, w: F.size(F.filter(x, lambda v: v == w))
    short = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))
    tagged = lambda x, one: F.transform(x, lambda v: F.struct(v.alias("w"), F.lit(one).alias("one")))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("n"))

    def step(acc, v):
        same = acc["w"] == v["w"]
        kept = lambda k: F.when(same, acc[k]).otherwise(0)
        return F.struct(
            v["w"].alias("w"), (kept("x") + F.when(v["one"], 1).otherwise(0)).alias("x"), (kept("y") + F.when(v["one"], 0).otherwise(1)).alias("y"),
            F.when(same, acc["n"]).otherwise(acc["n"] + F.least(acc["x"], acc["y"])).alias("n"),
        )

    long = F.aggregate(F.array_sort(F.concat(tagged(a, True), tagged(b, False))), start, step, lambda acc: acc["n"] + F.least(acc["x"], acc["y"]))
    return F.when(F.size(a) * F.size(b) <= PRODUCT, short).otherwise(long)


def coverage(response: Column, expected: Column) -> Column:
    """Expected words (as a bag) that the response holds; 0 without expected words."""
    return T.let(T.words(response), lambda r: T.let(T.words(expected), lambda e: F.when(F.size(e) == 0, F.lit(0.0)).otherwise(overlap(e, r) / F.size(e))))


def repetition(response: Column, n: int = 3) -> Column:
    """1 minus distinct runs of n words over all; 0 where there are none."""

    def ratio(w):
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(runs)) / F.size(runs))

    return T.let(T.words(response), ratio)


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall of words (with inner hyphens and underscores) as bags."""
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9][a-z0-9_-]*"), 0)

    def f1(p, r):
        o = overlap(p, r)
        return F.when((F.size(p) == 0) | (F.size(r) == 0) | (o == 0), F.lit(0.0)).otherwise(2.0 * o / (F.size(p) + F.size(r)))

    return T.let(toks(prediction), lambda p: T.let(toks(reference), lambda r: f1(p, r)))


def score(df: DataFrame, response: str = "response", concepts: str = "expected_concepts", expected: str = "expected_continuation") -> DataFrame:
    """``df`` with concept hits and recall, exact prefix, common prefix, coverage and repetition; what has no expectation is null."""
    r = F.coalesce(F.col(response), F.lit(""))
    e = F.when(F.coalesce(F.col(expected), F.lit("")) != "", F.col(expected))
    n = F.coalesce(F.size(F.col(concepts)), F.lit(0))
    n = F.when(F.col(concepts).isNull(), F.lit(0)).otherwise(n)
    x = df.withColumn("concept_hits", concept_hits(F.col(concepts), r).cast("bigint")).withColumn("concept_count", n.cast("bigint"))
    return (
        x.withColumn("concept_recall", F.when(F.col("concept_count") > 0, F.col("concept_hits") / F.col("concept_count")))
        .withColumn("exact_prefix", F.when(e.isNotNull(), phrase(r).startswith(phrase(e))))
        .withColumn("common_prefix", F.when(e.isNotNull(), common_prefix_ratio(r, e)))
        .withColumn("coverage", F.when(e.isNotNull(), coverage(r, e)))
        .withColumn("repetition", repetition(r))
    )


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Micro and macro concept recall, exact prefixes, averages, by group."""
    hits, n = F.sum("concept_hits"), F.sum("concept_count")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"), hits.alias("concept_hits"), n.alias("concept_count"), F.when(n > 0, hits / n).alias("micro_recall"), F.avg("concept_recall").alias("macro_recall"),
        F.count_if(F.col("exact_prefix")).alias("exact_matches"), F.count("exact_prefix").alias("exact_queries"), F.avg("common_prefix").alias("mean_prefix"), F.avg("coverage").alias("mean_coverage"),
        F.avg("repetition").alias("mean_repetition"),
    )


def paired(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Inner join of two stages; the values get 'base_' and 'new_'."""
    b = before.select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    a = after.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    return b.join(a, keys)


def key_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one stage has."""
    one = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("only_base"))
    return one.unionByName(after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("only_new")))


def verdict(p: DataFrame) -> DataFrame:
    """Deltas, the ordered verdict of a pair, and the note of what changed."""
    recall = F.coalesce("new_concept_recall", F.lit(0.0)) - F.coalesce("base_concept_recall", F.lit(0.0))
    x = p.withColumn("concept_delta", recall).withColumn("hit_delta", F.col("new_concept_hits") - F.col("base_concept_hits"))
    x = x.withColumn("prefix_delta", F.coalesce(F.col("new_common_prefix") - F.col("base_common_prefix"), F.lit(0.0)))
    x = x.withColumn("repetition_delta", F.col("new_repetition") - F.col("base_repetition"))
    c, q, r = F.col("concept_delta"), F.col("prefix_delta"), F.col("repetition_delta")
    return x.withColumn(
        "verdict",
        F.when(c > 0, "Knowledge improved").when(c < 0, "Possible forgetting").when(q > 0, "Continuation improved").when(q < 0, "Continuation regressed")
        .when(r <= -0.10, "Less repetitive").when(r >= 0.10, "More repetitive").otherwise("No clear change"),
    ).withColumn("note", change_note())


def change_note() -> Column:
    h, q, r = F.col("hit_delta"), F.col("prefix_delta"), F.col("repetition_delta")
    noun = F.when(F.abs(h) == 1, "concept").otherwise("concepts")
    sign = F.when(h > 0, F.concat(F.lit("+"), h.cast("string"))).otherwise(h.cast("string"))
    points = F.floor(F.abs(q) * 1000 + 0.5) / 10
    parts = F.array_compact(
        F.array(
            F.when(h != 0, F.concat(sign, F.lit(" expected "), noun)),
            F.when(F.abs(q) > 0.0001, F.format_string("exact prefix %s%.1f pp", F.when(q > 0, "+").otherwise("-"), points)),
            F.when(r <= -0.10, "less repetitive").when(r >= 0.10, "more repetitive"),
        )
    )
    return F.when(F.size(parts) == 0, "no measured change").otherwise(F.array_join(parts, "; "))


def pair_verdict(p: DataFrame) -> DataFrame:
    """Needs Improvement, Good or Satisfactory: concepts, coverage and repetition by a tenth, empty answers; and the stricter Degraded or Retained."""
    h = F.col("new_concept_hits") - F.col("base_concept_hits")
    c = F.coalesce(F.col("new_coverage") - F.col("base_coverage"), F.lit(0.0))
    r = F.col("new_repetition") - F.col("base_repetition")
    empty = T.strip(F.coalesce("new_response", F.lit(""))) == ""
    worse, better = (h < 0) | (c < -0.10) | (r > 0.10), (h > 0) | (c > 0.10) | (r < -0.10)
    return p.withColumn("assessment", F.when(empty | worse, "Needs Improvement").when(better, "Good").otherwise("Satisfactory")).withColumn(
        "forgetting", F.when(empty | (h < 0) | (r > 0.10), "Degraded").otherwise("Retained")
    )


def band(value: Column, good: float, fair: float, up: bool = True) -> Column:
    """Good, Satisfactory or Needs Improvement by two bounds."""
    ok = (lambda b: value >= b) if up else (lambda b: value <= b)
    return F.when(ok(good), "Good").when(ok(fair), "Satisfactory").otherwise("Needs Improvement")


def recall_band(base: Column, new: Column) -> Column:
    change = 100 * (new - base)
    return (
        F.when(base.isNull() | new.isNull(), "Needs Improvement").when((new >= 0.60) & (change >= -2.0), "Good").when((new >= 0.30) & (change >= -5.0), "Satisfactory").otherwise("Needs Improvement")
    )


def perplexity_band(change_percent: Column, kind: str) -> Column:
    """'domain' and 'reference' want a reduction by 10 percent, 'generic' and 'retention' at most 5 percent more."""
    if kind in ("domain", "reference"):
        return F.when(-change_percent >= 10.0, "Good").when(-change_percent > 0.0, "Satisfactory").otherwise("Needs Improvement")
    return band(change_percent, 5.0, 10.0, up=False)


def token_weighted(df: DataFrame, loss: str, tokens: str, *by: str) -> DataFrame:
    """(by, tokens, mean_loss, perplexity): exp of the loss summed over tokens; null without tokens; never a mean of perplexities."""
    n, nll = F.sum(tokens), F.sum(F.col(loss) * F.col(tokens))
    x = df.groupBy(*by).agg(n.alias("tokens"), nll.alias("_nll"))
    mean = F.when(F.col("tokens") > 0, F.col("_nll") / F.col("tokens"))
    return x.select(*by, "tokens", mean.alias("mean_loss"), F.exp(mean).alias("perplexity"))


def join_at_seam(prompt: Column, target: Column) -> Column:
    """struct<text, boundary>: prompt and target with one blank unless either has white space at the seam."""
    gap = F.when(prompt.rlike(f"[{T.WS}]\\z") | target.rlike(f"^[{T.WS}]"), F.lit("")).otherwise(F.lit(" "))
    return F.struct(F.concat(prompt, gap, target).alias("text"), F.length(prompt).alias("boundary"))


def first_filled(*columns: str) -> Column:
    """struct<field, value>: the first column that is not blank, stripped."""
    out = F.lit(None).cast("struct<field:string,value:string>")
    for c in reversed(columns):
        v = T.strip(F.coalesce(F.col(c), F.lit("")))
        out = F.when(v != "", F.struct(F.lit(c).alias("field"), v.alias("value"))).otherwise(out)
    return out


def resolve_by_name(left: DataFrame, name: str, right: DataFrame, stem: str, key: str) -> DataFrame:
    """(key, stem): rows whose name contains exactly one stem; none or several give no row."""
    return only_fragment(left, key, name, right, stem)


def retention_verdict(base: Column, new: Column) -> Column:
    """Improved, Degraded or Retained by the sign of a change in coverage; null counts as 0."""
    d = F.coalesce(new, F.lit(0.0)) - F.coalesce(base, F.lit(0.0))
    return F.when(d > 0, "Improved").when(d < 0, "Degraded").otherwise("Retained")


def relative_change(base: Column, new: Column) -> Column:
    """The change in percent of the base; null for a base of 0."""
    return F.when(base != 0, (new - base) / base * 100)


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Whether two values agree relative to the larger."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def resolve_by_id(left: DataFrame, key: str, ident: str, right: DataFrame, name: str) -> DataFrame:
    """(key, name): where only one file has the identifier, that file: the fallback of :func:`resolve_by_name`."""
    only = right.groupBy(ident).agg(F.countDistinct(name).alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")
    return left.select(key, ident).join(only, ident).select(key, name)
