"""Line-wise cleaning of finished texts: links, encoded data, packed lists, joined headings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T

#: What is taken out of lines, in this order.
LINK = r"(?i)\[([^\]]+)]\(https?://[^)]+\)"
URL = T.URL
BARE_URL = r"""(?i)https?://(?=[^\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}<>"'])[^\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}<>"']*?([.,;:!?)\]}]*)(?=[\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}<>"']|\z)"""
ENCODED = {
    "fingerprints_removed": r"(?i)(?:fingerprint[ \t]*[=:]?[ \t]*)?(?:[0-9a-f]{2}:){7,}[0-9a-f]{2}",
    "uuids_removed": r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![0-9a-f])",
    "long_hex_values_removed": r"(?i)(?<![0-9a-f])[0-9a-f]{40,}(?![0-9a-f])",
    "base64_values_removed": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{64,}={0,2}(?![A-Za-z0-9+/=])",
}
BEGIN, END = r"^-{5}BEGIN [A-Z0-9 ]+-{5}$", r"^-{5}END [A-Z0-9 ]+-{5}$"
PEM = r"(?ms)^[ \t]*-{5}BEGIN [A-Z0-9 ]+-{5}[ \t]*$.*?(?:^[ \t]*-{5}END [A-Z0-9 ]+-{5}[ \t]*$\n?|\z)"


def outside_blocks(rows: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """The rows of a table of lines that lie outside of BEGIN/END blocks.

    The state before a line is that of the last marker before it: BEGIN within a block and END outside of
    one change nothing.  A block that never ends goes to the end of its text.  For whole
    texts in one row :func:`post_clean` does the same without a shuffle.
    """
    begins, ends = F.trim(line).rlike(BEGIN), F.trim(line).rlike(END)
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.when(begins, True).when(ends, False), ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("_inside", inside).where(~F.col("_inside") & ~begins).drop("_inside")


@dataclass(frozen=True)
class LineConfig:
    """Each step can be left out; a result below ``min_chars`` gives the original back."""

    urls: bool = True
    encoded: bool = True
    packed_lists: bool = True
    joined_headings: bool = True
    suspicious: bool = True
    min_chars: int = 50


def remove_urls(line: Column) -> Column:
    """Links become their labels; a line that is mostly addresses becomes empty; of others the closing marks stay."""

    def bare(x):
        share = F.aggregate(F.regexp_extract_all(x, F.lit(URL), 0), F.lit(0), lambda a, u: a + F.length(u)) / F.greatest(F.length(T.strip(x)), F.lit(1))
        return F.when(~x.rlike(URL), x).when(share >= 0.60, F.lit("")).otherwise(T.sub(x, BARE_URL, "$1"))

    return T.let(T.sub(line, LINK, "$1"), bare)


def remove_encoded(line: Column) -> Column:
    for pattern in ENCODED.values():
        line = T.sub(line, pattern)
    return line


def split_packed(line: Column) -> Column:
    """A blank after each comma and semicolon of words of 60 characters that hold three of them."""
    words = F.regexp_extract_all(line, F.lit(f"[{T.WS}]+|[^{T.WS}]+"), 0)
    fixed = F.transform(
        words, lambda w: F.when((F.length(w) >= 60) & (F.regexp_count(w, F.lit("[,;]")) >= 3), T.sub(w, rf"([,;])(?=[^{T.WS}])", "$1 ")).otherwise(w)
    )
    return F.when(line.rlike(f"[^{T.WS}]{{60,}}"), F.array_join(fixed, "")).otherwise(line)


def repair_headings(line: Column) -> Column:
    """'Table12:x' becomes 'Table 12: x'; runs of 30 letters with two inner capitals are split at them."""
    labelled = T.sub(line, rf"\b(Table|Figure|Example)([0-9]+):(?=[^{T.WS}])", "$1 $2: ")
    inner = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    parts = F.regexp_extract_all(labelled, F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)
    fixed = F.transform(parts, lambda w: F.when((F.length(w) >= 30) & (F.size(F.split(w, inner)) >= 3), T.sub(w, inner, " ")).otherwise(w))
    return F.when(labelled.rlike("[A-Za-z]{30,}"), F.array_join(fixed, "")).otherwise(labelled)


def is_suspicious(line: Column) -> Column:
    """Whether a line of 180 characters has at most two words, one of them of 160."""
    return T.let(
        T.strip(line),
        lambda s: (F.length(s) >= 180)
        & T.let(F.regexp_extract_all(s, F.lit(f"[^{T.WS}]+"), 0), lambda w: (F.size(w) <= 2) & (F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)) >= 160)),
    )


def post_clean(text: Column, cfg: LineConfig = LineConfig()) -> Column:
    """The cleaned text; null for null."""
    trail = f"[{T.WS.replace(chr(92) + 'n', '')}]+(?=\n|\\z)"
    x = T.sub(T.line_ends(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
    if cfg.encoded:
        x = T.sub(x, PEM)
    x = T.sub(x, trail)

    def by_line(pattern, body):
        """Line by line, but only texts in which there is anything to do."""
        return lambda v: F.when(v.rlike(pattern), F.array_join(body(F.split(v, "\n")), "\n")).otherwise(v)

    steps = []
    if cfg.urls:
        steps.append(by_line(r"(?i)https?://", lambda ls: F.transform(ls, remove_urls)))
    if cfg.encoded:
        steps.append(remove_encoded)  # no pattern crosses a line
    if cfg.packed_lists:
        steps.append(by_line(f"[^{T.WS}]{{60,}}", lambda ls: F.transform(ls, split_packed)))
    if cfg.joined_headings:
        steps.append(by_line(r"[A-Za-z]{30,}|\b(?:Table|Figure|Example)[0-9]+:", lambda ls: F.transform(ls, repair_headings)))
    steps.append(lambda v: T.sub(v, trail))
    if cfg.suspicious:
        steps.append(by_line(f"[^{T.WS}]{{160,}}", lambda ls: F.filter(ls, lambda v: ~is_suspicious(v))))
    for step in steps:
        x = T.let(x, step)
    out = T.strip(T.sub(x, "\n{3,}", "\n\n"))
    return T.let(out, lambda o: F.when(F.length(o) < cfg.min_chars, text).otherwise(F.concat(o, F.lit("\n"))))


def actions(text: Column) -> Column:
    """array<struct<action, n>>: how often each step finds something in the raw text."""
    pem = F.regexp_extract_all(text, F.lit(PEM), 0)
    begins = F.aggregate(pem, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(r"(?m)^[ \t]*-{5}BEGIN [A-Z0-9 ]+-{5}[ \t]*$")))
    payload = F.aggregate(pem, F.lit(0), lambda a, s: a + F.size(F.split(T.sub(s, r"\n\z"), "\n"))) - begins
    pairs = {
        "markdown_urls_removed": F.regexp_count(text, F.lit(LINK)),
        "pem_blocks_removed": begins,
        "pem_payload_lines_removed": payload,
        **{k: F.regexp_count(text, F.lit(p)) for k, p in ENCODED.items()},
    }
    return F.array(*[F.struct(F.lit(k).alias("action"), v.cast("bigint").alias("n")) for k, v in pairs.items()])


def action_totals(docs: DataFrame, text: str) -> DataFrame:
    """(action, total, documents) over the corpus."""
    x = docs.select(F.explode(actions(F.col(text))).alias("a")).where("a.n > 0")
    return x.groupBy("a.action").agg(F.sum("a.n").alias("total"), F.count(F.lit(1)).alias("documents"))
