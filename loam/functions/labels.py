"""Labels that were written in several ways, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of languages -> two-letter code.
LANGUAGES = {
    "eng": "en", "english": "en", "ger": "de", "deu": "de", "german": "de", "deutsch": "de",
    "fre": "fr", "fra": "fr", "french": "fr", "français": "fr", "spa": "es", "spanish": "es", "español": "es",
    "dut": "nl", "nld": "nl", "dutch": "nl", "ita": "it", "italian": "it", "por": "pt", "portuguese": "pt",
}


def label(c: Column | str) -> Column:
    """Lower case, no outer blanks, single hyphens between words; null and blank become 'unknown'."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.btrim(F.regexp_replace(F.lower(c), r"[\s_\- ]+", "-"), F.lit("-"))
    return F.when(x.isNull() | (x == ""), "unknown").otherwise(x)


def language(c: Column | str) -> Column:
    """The two-letter code of a language label, whatever its case, region or name; null, blank and 'und' become 'unknown'."""
    x = F.element_at(F.split(label(c), "-"), 1)
    table = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    return F.when(x == "und", "unknown").otherwise(F.coalesce(F.try_element_at(table, x), x))
