"""Scalar text functions as Spark columns: everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a character class of both Java and RE2.
WS = r"\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}"
#: Control and format characters except line feed and tab.
CONTROLS = r"[\x00-\x08\x0B-\x1f\x7f-\x9f\p{Cf}]"
#: Glyphs of damaged fonts and what they stand for.
GLYPHS = {
    "": "fi", "": "fl", "": "ff", "": "ffi", "": "ffl",
    "": "•", "": "•", "": "→", "": "Δ",
}
URL = r"""(?i)https?://[^\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}<>"']+"""
LONG_HEX = r"(?i)[0-9a-f]{40,}"
BASE64 = r"[A-Za-z0-9+/]{64,}={0,2}(?:[^A-Za-z0-9+/=]|\z)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once (a lambda would evaluate it for each element)."""
    return F.transform(F.array(value), body)[0]


def sub(c: Column | str, pattern: str, by: str = "") -> Column:
    """``regexp_replace`` of all matches."""
    return F.regexp_replace(col(c), pattern, by)


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.btrim(sub(c, f"[{WS}]+", " "), F.lit(" "))


def fold(c: Column | str, casefold: bool = False) -> Column:
    """Lower case; with ``casefold`` sharp s becomes ss."""
    low = F.lower(col(c))
    return F.replace(low, F.lit("ß"), F.lit("ss")) if casefold else low


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return sub(c, f"^[{WS}]+|[{WS}]+\\z")


def line_ends(c: Column | str) -> Column:
    """CR LF and CR become LF."""
    return sub(sub(c, "\r\n", "\n"), "\r", "\n")


def strip_digest_header(c: Column | str) -> Column:
    """Without the cache header line of a text extractor."""
    return sub(c, r"(?m)^#[ \t]*MD5:[ \t]*[a-fA-F0-9]{32}[ \t]*\n?")


def strip_bom(c: Column | str) -> Column:
    return sub(c, "^﻿")


def cap_blank_lines(c: Column | str) -> Column:
    """No blanks before line ends, at most one blank line in a row."""
    return sub(sub(c, r"[ \t]+\n", "\n"), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")


def canonical(c: Column | str) -> Column:
    """The clean text of the gates: line ends, header line, table markers, controls, blank runs."""
    x = strip_digest_header(line_ends(c))
    x = sub(x, r"(?mi)^[ \t]*\[EXTRACTED TABLES\]:?[ \t]*\n?")
    return strip(cap_blank_lines(sub(x, CONTROLS)))


def digit_mask(c: Column | str) -> Column:
    """A line for comparison: lower case, numbers masked, white space squeezed."""
    return squeeze(sub(F.lower(col(c)), "[0-9]+", "<n>"))


def alnum_key(c: Column | str) -> Column:
    """Lower-case letters a-z and digits, all else one blank."""
    return F.btrim(sub(F.lower(col(c)), "[^a-z0-9]+", " "), F.lit(" "))


def compact(c: Column | str) -> Column:
    """White space squeezed, no blanks or hyphens at the ends."""
    return F.btrim(sub(c, f"[{WS}]+", " "), F.lit(" -\t\r\n"))


def words(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), 0)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def translate_glyphs(c: Column | str) -> Column:
    """Private-use glyphs become the characters they stand for."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), GLYPHS.items(), col(c))


def glyph_counts(c: Column | str) -> Column:
    """Map 'U+E023' -> times, of the glyphs that occur."""
    x = col(c)
    pairs = F.array(
        *[F.struct(F.lit(f"U+{ord(g):04X}").alias("k"), (F.length(x) - F.length(F.replace(x, F.lit(g), F.lit("")))).alias("v")) for g in sorted(GLYPHS)]
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def preview(c: Column | str, most: int = 180) -> Column:
    """The squeezed beginning."""
    return F.substring(squeeze(c), 1, most)


def clip(c: Column | str, most: int = 160, mark: str = "...") -> Column:
    """Squeezed; longer than ``most`` it is cut and marked within that length."""
    x = squeeze(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - len(mark)), F.lit(mark))).otherwise(x)


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"([^/\\]*)$", 1)


def stem(c: Column | str) -> Column:
    """The file's name without its last suffix."""
    return sub(file_name(c), r"(?<=.)\.[^.]*$")


def suffix(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r".(\.[^.]*)$", 1))


def safe_name(c: Column | str) -> Column:
    """A file name of letters, digits, dots, underscores and hyphens."""
    x = F.btrim(sub(c, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.when(x == "", "document").otherwise(x)


def document_id(corpus: Column | str, path: Column | str) -> Column:
    """corpus-slug-hash: stable for a path within a corpus."""
    slug = F.btrim(sub(F.lower(stem(path)), "[^a-z0-9]+", "-"), F.lit("-"))
    digest = F.sha2(F.concat_ws("/", col(corpus), col(path)), 256)
    return F.concat_ws("-", col(corpus), F.substring(slug, 1, 72), F.substring(digest, 1, 12))


def seeded_rank(seed: int, key: Column | str) -> Column:
    """The hash order that shuffles everywhere: SHA-256 of 'seed:key'."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)


def markdown_table(rows: Column | str) -> Column:
    """array<array<string>> -> a Markdown table: cells on one line, short rows filled up, a rule below the first row."""
    return let(col(rows), lambda x: let(F.array_max(F.transform(x, F.size)), lambda width: _markdown(x, width)))


def _markdown(x: Column, width: Column) -> Column:
    def line(r):
        cells = F.transform(r, lambda v: F.btrim(sub(F.coalesce(v, F.lit("")), r"[\r\n]+", " "), F.lit(" ")))
        return F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), " | "), F.lit(" |"))

    lines = F.transform(x, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(x) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(x), F.lit(1)))), "\n"))


def perplexity(loss: Column | str, most: float = 20.0) -> Column:
    """exp(loss), infinite from ``most`` on, null for null."""
    x = col(loss)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < most, F.exp(x)).otherwise(F.lit(float("inf")))


def percent(ratio: Column | str, digits: int = 1) -> Column:
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f%%", F.floor(col(ratio) * 100 * scale + 0.5) / scale)


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("bigint")


def alpha_ratio(c: Column | str) -> Column:
    """Letters among the characters that are not white space."""
    x = col(c)
    letters = F.length(sub(x, r"[^\p{L}]"))
    return letters / F.greatest(F.length(sub(x, f"[{WS}]+")), F.lit(1))


def split_lines(c: Column | str) -> Column:
    """Lines; a last line end begins no further line. Null gives null."""
    x = sub(col(c), "\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return F.split(sub(x, r"\n\z"), "\n", -1)
