"""Patterns in which digits and white space are those of any script.

Records use full-width digits and ideographic spaces beside the plain ones. In a pattern that goes through wide(), \\d stands
for any decimal digit and \\s for any white space, inside character classes too; number() reads such digits.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for white space within a character class: ASCII's, the four separators and the next line, and all of Unicode's.
_SPACES = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: An escaped character, a border of a character class, or anything else.
_TOKEN = re.compile(r"\\(?s:.)|\[\^?|\]|(?s:.)")


@functools.cache
def wide(pattern: str) -> str:
    """The pattern with \\d, \\D, \\s and \\S meaning digits and white space of any script. A class may hold the first and the
    third; [0-9] stays what it says."""
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        if token.startswith("[") and not inside:
            inside = True
        elif token == "]" and inside:
            inside = False
        elif token == r"\d":
            token = r"\p{Nd}"
        elif token == r"\D" and not inside:
            token = r"\P{Nd}"
        elif token == r"\s":
            token = _SPACES if inside else f"[{_SPACES}]"
        elif token == r"\S" and not inside:
            token = f"[^{_SPACES}]"
        elif token in (r"\D", r"\S"):
            raise ValueError("a complement inside a character class")
        out.append(token)
    return "".join(out)


@functools.cache
def _digits() -> tuple[str, str]:
    """(decimal digits of all scripts but ASCII, the ASCII digit of each)."""
    found = [(chr(c), unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(c for c, _ in found), "".join(str(d) for _, d in found)


def plain_digits(c: Column) -> Column:
    """The text with decimal digits of any script as ASCII ones."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, *_digits())).otherwise(c)


def number(c: Column) -> Column:
    """The integer that a run of decimal digits of any script stands for; null for anything else."""
    return plain_digits(c).try_cast("int")


@functools.cache
def _blanks() -> str:
    """The characters of _SPACES."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"))


def strip(c: Column) -> Column:
    """Without white space of any script at either end; what is between isn't looked at."""
    return F.btrim(c, F.lit(_blanks()))


def blank(c: Column) -> Column:
    """Whether a text is null or has white space only."""
    return ~F.coalesce(c, F.lit("")).rlike(wide(r"\S"))
