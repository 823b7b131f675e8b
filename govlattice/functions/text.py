"""Text expressions: folding, counting, match positions, check digits.

Everything here is a plain Column expression, so it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlattice.rules.personal_data import FOLD_FROM, FOLD_TO

SPAN_TYPE = "array<struct<start:int,end:int,text:string>>"


def pattern(regex: str, ignore_case: bool = False) -> str:
    """Java flags matching Unicode-aware, newline-strict regular expressions."""
    return f"(?{'iu' if ignore_case else ''}Ud){regex}"


# Everything that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim any Unicode white space, not just blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def holds_any(col: Column, *parts: str) -> Column:
    """Whether a text holds one of a few literal strings: far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def swap(col: Column, *pairs: tuple[str, str]) -> Column:
    """Replace literal strings one after the other: far cheaper than a pattern or
    a character map on texts that hold none of them."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def is_blank(col: Column) -> Column:
    return F.coalesce(~col.rlike(r"(?U)\S"), F.lit(True))


def fold(col: Column) -> Column:
    """Lower-case without accents, keeping the number of characters.

    Accented letters are mapped before lower-casing: lower-casing first could
    lengthen the text (dotted capital I) and shift every later offset.
    """
    return F.lower(
        F.translate(col, FOLD_FROM + FOLD_FROM.upper() + "İ", FOLD_TO + FOLD_TO + "i")
    )


def normalize_spaces(col: Column) -> Column:
    """NBSP becomes a blank, zero-width space disappears, runs of blanks shrink."""
    cleaned = swap(col, ("\xa0", " "), ("\u200b", ""))
    return strip(F.regexp_replace(cleaned, r"[ \t\r\f\x0B]+", " "))


def tidy_spaces(col: Column) -> Column:
    """As :func:`normalize_spaces`; a text that has nothing to change is only looked at.

    ``col`` is read several times, so it should be a plain column.
    """
    ends = F.contains(F.lit(WHITE_SPACE), F.left(col, F.lit(1))) | F.contains(F.lit(WHITE_SPACE), F.right(col, F.lit(1)))
    odd = ends | holds_any(col, "  ", "\t", "\r", "\f", "\x0b", "\xa0", "\u200b")
    return F.when(odd, normalize_spaces(col)).otherwise(col)


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\w+"), F.lit(0))


def comparable_text(col: Column) -> Column:
    """Lower-cased words only: case, spacing and punctuation do not count."""
    return F.array_join(words(col), " ")


def spans(col: Column, regex: str | Column) -> Column:
    """All matches of ``regex`` with 0-based, end-exclusive code-point offsets.

    The pieces between the matches and the matches themselves alternate, so a
    running sum of both lengths gives every offset without leaving the JVM.
    Texts without a match skip the split.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    found = F.regexp_extract_all(col, regex, F.lit(0))
    pieces = F.split(col, regex, -1)
    empty = F.array().cast(SPAN_TYPE)
    init = F.struct(F.lit(0).alias("pos"), empty.alias("out"))

    def step(acc: Column, item: Column) -> Column:
        start = acc["pos"] + F.length(item["gap"])
        end = start + F.length(item["hit"])
        return F.struct(
            end.alias("pos"),
            F.concat(
                acc["out"],
                F.array(F.struct(start.alias("start"), end.alias("end"), item["hit"].alias("text"))),
            ).alias("out"),
        )

    pairs = F.zip_with(pieces, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    walked = F.aggregate(pairs, init, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(col, regex), walked).otherwise(empty)


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def _digit_array(col: Column) -> Column:
    return F.transform(F.split(col, ""), lambda c: c.try_cast("int"))


def _check_digit(digits: Column, weights: Sequence[int]) -> Column:
    weighted = F.zip_with(
        F.slice(digits, 1, len(weights)),
        F.array(*[F.lit(w) for w in weights]),
        lambda d, w: d * w,
    )
    rest = F.aggregate(weighted, F.lit(0), lambda a, b: a + b) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def valid_check_digits(col: Column, weights: tuple[tuple[int, ...], tuple[int, ...]]) -> Column:
    """Two modulo-11 check digits at the end of a digit string (CPF, CNPJ).

    Each weight list covers the digits in front of its check digit, so a number
    is right exactly when both stored digits equal the computed ones. A number
    made of one repeated digit is rejected.
    """
    size = len(weights[1]) + 1
    first, second = weights
    digits = _digit_array(col)
    return F.when(
        F.length(col) == size,
        (F.get(digits, F.lit(size - 2)) == _check_digit(digits, first))
        & (F.get(digits, F.lit(size - 1)) == _check_digit(digits, second))
        & (F.size(F.array_distinct(digits)) > 1),
    ).otherwise(False)
