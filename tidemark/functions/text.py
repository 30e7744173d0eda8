"""Text normalisers: strip, CR/LF, NFKC, whitespace collapsing, accents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that str.isspace() accepts.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Blocks in which every character is its own NFKC form and combines with no
# other character of these blocks.  Text made of them alone needs no Python.
NFKC_STABLE = (
    r"\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e"
    r"\u0141-\u0148\u014a-\u017e\u0400-\u0482\u2010\u2012-\u2016\u2018-\u2022"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)


def strip_ws(col: Column) -> Column:
    """Unicode strip on both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def unify_newlines(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_ws(col: Column) -> Column:
    return F.regexp_replace(col, SPACE_RUN, " ")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(text: pd.Series) -> pd.Series:
    def strip_marks(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(strip_marks, na_action="ignore")


def nfkc(col: Column) -> Column:
    """NFKC form.  Rows that cannot change travel to Python as nulls."""
    # the intersection settles ASCII characters with its first, cheap test
    changes = F.when(col.rlike(rf"[\xa0-\x{{10ffff}}&&[^{NFKC_STABLE}]]"), col)
    return F.coalesce(_nfkc(changes), col)


def strip_accents(col: Column) -> Column:
    """Compatibility-decompose and drop combining marks; ASCII rows stay in the JVM."""
    changes = F.when(F.octet_length(col) != F.length(col), col)
    return F.coalesce(_without_marks(changes), col)


def normalize_train(col: Column) -> Column:
    return strip_ws(unify_newlines(col))


def normalize_serve(col: Column, max_length: int = 20000) -> Column:
    out = strip_ws(unify_newlines(F.coalesce(col, F.lit(""))))
    out = F.regexp_replace(out, "\t[ \t]*| [ \t]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.left(out, F.lit(max_length)) if max_length > 0 else out


def normalize_clean(col: Column) -> Column:
    """NFKC, line ends and whitespace runs to single spaces, stripped; null stays null."""
    return F.trim(collapse_ws(nfkc(col)))


def content_digest(col: Column) -> Column:
    """Short stand-in for a long text as a grouping or join key."""
    return F.unhex(F.sha2(col, 256))
