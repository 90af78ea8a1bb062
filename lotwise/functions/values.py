"""Column helpers for loosely typed records: two notions of emptiness, lenient numbers, rounding and padding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used: as columns, each use would be a copy of its expression."""
    return F.transform(F.array(value), use)[0]


def filled(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    c = col(c)
    return F.when(c != "", c)


def has_value(c: Column | str) -> Column:
    """Neither null nor empty text; 0 and false count as values."""
    c = col(c)
    return c.isNotNull() & (c.cast("string") != "")


def truthy(c: Column | str, kind: str = "string") -> Column:
    """Truth of a scripting language: null, "", 0 and false are false, any other text (even "false") is true."""
    c = col(c)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    empty = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(c != empty, F.lit(False))


def first_filled(*cs: Column | str) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in cs])


def lenient_int(c: Column | str) -> Column:
    """Integer of a text or number; null for null, empty text and whatever isn't a whole number in text form. Numbers
    are cut towards zero."""
    return F.expr("null") if c is None else col(c).try_cast("bigint").cast("int")


def text_int(c: Column | str) -> Column:
    """Integer of a text: blanks around it are allowed, a decimal point is not."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def lenient_float(c: Column | str) -> Column:
    """Double of a text, 0 where it is none."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounding to even on ties."""
    return F.bround(col(c), digits)


def strip_zeros(c: Column | str) -> Column:
    """Text without leading zeros; "0" if nothing is left."""
    t = F.regexp_replace(col(c), "^0+", "")
    return F.when(t == "", "0").otherwise(t)


def zero_fill(c: Column | str, width: int) -> Column:
    """Text padded with zeros on the left, never cut."""
    c = col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), WS, " "))


def swap_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The entry of a literal table, null where there is none."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(m, c)


def alias_or_self(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(lookup(c, table), c)


def path_of(url: Column) -> Column:
    """The path of a URL, percent escapes decoded, a plus kept as it is."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=/)", ""), r"^//[^/?#]*", "")
    return unquote(F.regexp_replace(path, r"[?#].*$", ""))


def unquote(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def stem_of(path: Column) -> Column:
    """The last part of a path without its last extension."""
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_extract(last, r"^(.+)\.[^.]+$", 1)).otherwise(last)
