"""Native column expressions for the string semantics the jobs share.

Everything here returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen (no Python worker).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """Python truthiness of a string: not NULL and not empty."""
    c = col_(c)
    return c.isNotNull() & (c != F.lit(""))


def present_arr(c) -> Column:
    """Python truthiness of a list: at least one element."""
    return F.coalesce(F.size(col_(c)), F.lit(0)) > 0


# The characters ``str.strip()`` removes: every code point ``str.isspace()`` accepts.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace (a character-set trim,
    linear in the trimmed ends only)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def words(c) -> Column:
    """``str.split()`` with no argument: whitespace runs, no empty tokens."""
    return F.filter(F.split(col_(c), r"(?U)\s+"), lambda t: t != F.lit(""))


def word_count(c) -> Column:
    return F.size(words(c))


def rfind(c, needle: str, end) -> Column:
    """0-based ``text.rfind(needle, 0, end)``; -1 when absent.

    The match must lie wholly inside ``[0, end)``: search the reversed prefix.
    """
    end = end if isinstance(end, Column) else F.lit(end)
    prefix = F.substring(col_(c), F.lit(1), F.greatest(end, F.lit(0)))
    i = F.instr(F.reverse(prefix), needle[::-1])
    return F.when(i == 0, F.lit(-1)).otherwise(F.length(prefix) - i - F.lit(len(needle)) + 1)


def collapse_ws(c) -> Column:
    """Squash every whitespace run to one space and strip."""
    return F.trim(F.regexp_replace(col_(c), r"(?U)\s+", " "))


def cut_at_stops(c, stops: list[str]) -> Column:
    """For each stop string in turn keep the text before its first occurrence."""
    out = col_(c)
    for s in stops:
        out = F.substring_index(out, s, 1)
    return out
