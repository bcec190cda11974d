"""Unicode normalisation, which no built-in function offers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loam.functions import text as T


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass unchanged, null stays null."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalised(c: Column | str) -> Column:
    """NFKC, line feeds only, no blanks at line ends, one blank line at most, stripped."""
    x = T.line_ends(nfkc(T.col(c)))
    x = T.sub(x, f"[{T.WS.replace(chr(92) + 'n', '')}]+\n", "\n")
    return T.strip(T.cap_blank_lines(x))
