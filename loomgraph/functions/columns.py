"""Column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate value so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


# every character that a regular expression counts as white space with (?U)
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def quote_regex(text: str) -> str:
    """A literal as a Java regular expression."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" else ch for ch in text)


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def substring_from(c: Column, start: int) -> Column:
    """0-based `substring(x, start, n)` without a length."""
    return F.substring(c, start + 1, 1_000_000_000)


def substring0(c: Column, start: int, length: int) -> Column:
    """0-based substring, as graph query languages count."""
    return F.substring(c, start + 1, length)


def to_integer(c: Column) -> Column:
    """`toInteger`: null on failure, fractions cut."""
    return c.try_cast("double").try_cast("bigint")


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def sorted_rows_md5(c: Column) -> Column:
    """Result key: md5 over the sorted rows of an array column."""
    return F.md5(F.array_join(F.array_sort(c), "\n").cast("binary"))


def rows_to_json(rows: Column) -> Column:
    """JSON text of an array of row structs; nulls are kept, text stays readable."""
    return F.to_json(rows, {"ignoreNullFields": "false"})


def name_key(prefix: str, names: Column) -> Column:
    """Cache key of a group of names: order does not matter."""
    return F.concat(F.lit(prefix), F.md5(F.array_join(F.array_sort(names), ";").cast("binary")))
