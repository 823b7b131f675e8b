"""Legal markup to one block of text per line."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.text import strip, swap

# Which markup disappears with its content and which breaks a line.
DROPPED = r"(?is)<(script|style|head|title)\b.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
STRUCK = r"(?is)<(strike|s|del)\b[^>]*>.*?</\1\s*>"
LINE_THROUGH = (
    r"(?is)<(span|font|p|a)\b[^>]*text-decoration\s*:\s*line-through[^>]*>.*?</\1\s*>"
)
BLOCK = r"(?i)<br\s*/?>|</?(?:p|div|h[1-6]|tr|li|table|blockquote|center)\b[^>]*>"
TAG = r"(?s)<[^>]+>"
STRUCK_PASSES = 3
# What html.unescape takes for a reference.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def decode_bytes(raw: Column) -> Column:
    """UTF-8 where valid, else Windows-1252."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(_cp1252(raw))


def _cp1252_series(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("cp1252", errors="replace"))


def _cp1252(raw: Column) -> Column:
    """The code page is not among those SQL decodes; valid UTF-8 is not sent over."""
    invalid = F.when(~F.is_valid_utf8(raw.cast("string")), raw)
    return F.pandas_udf(_cp1252_series, "string")(invalid)


def _unescape_series(found: pd.Series) -> pd.Series:
    return found.map(lambda refs: [html.unescape(r) for r in refs], na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references to characters; only the references travel, texts stay where they are.

    ``text`` is read several times, so it should be a plain column.
    """
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    plain = F.pandas_udf(_unescape_series, "array<string>")(F.when(text.contains("&"), found))
    # One more piece than references.
    joined = F.zip_with(F.split(text, REFERENCE, -1), plain, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.coalesce(F.array_join(joined, ""), text)


def legal_text(df: DataFrame, markup: str, name: str = "text") -> DataFrame:
    """Add the plain text of a markup column, one block per line."""
    # Python's and HTML's idea of white space includes the separator controls.
    space = r"(?U)[\s\x1E\x1F]+"
    t = swap(F.col(markup), ("\x1c", "“"), ("\x1d", "”"), ("\x00", ""))
    t = F.regexp_replace(t, DROPPED, " ")
    t = F.regexp_replace(t, COMMENT, " ")
    # Struck-out passages are rare; most markup skips the six passes.
    hint = r"(?i)<(?:s|strike|del)\b|line-through"
    staged = df.withColumn("_t", t)
    struck = F.col("_t")
    for _ in range(STRUCK_PASSES):
        struck = F.regexp_replace(struck, STRUCK, " ")
        struck = F.regexp_replace(struck, LINE_THROUGH, " ")
    staged = staged.withColumn(
        "_t", F.when(F.col("_t").rlike(hint), struck).otherwise(F.col("_t"))
    )
    t = F.regexp_replace("_t", space, " ")
    t = F.regexp_replace(t, BLOCK, "\n")
    t = F.regexp_replace(t, TAG, " ")
    staged = staged.withColumn("_t", t).withColumn("_t", unescape(F.col("_t")))
    t = F.regexp_replace(F.translate("_t", " ", " "), r"[ \t]+", " ")
    lines = F.transform(
        F.split(t, "\n"),
        lambda l: F.regexp_replace(strip(l), r"^Art \.", "Art."),
    )
    return staged.withColumn(name, F.array_join(F.filter(lines, lambda l: l != ""), "\n")).drop(
        "_t"
    )
