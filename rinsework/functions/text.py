r"""Text cleaning expressions with Python's Unicode character classes.

Java's ``\w``, ``\d`` and ``\s`` are ASCII only, so the classes are spelled out. The same spellings
work in other regular expression engines, which keeps results comparable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: members of the Unicode white space, word and digit classes
SPACE = r"\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACES = "".join(
    chr(c)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(first, last + 1)
)


def strip(c: Column) -> Column:
    """Remove all white space at both ends, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Turn every run of white space into one blank and strip the ends."""
    # single blanks, by far the most common, need no replacement
    return F.btrim(F.regexp_replace(c, f"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " "))


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{WORD}{SPACE}]", "")


def drop_digits(c: Column) -> Column:
    return F.regexp_replace(c, f"{DIGIT}+", "")


def drop_special(c: Column) -> Column:
    """Keep ASCII letters, digits and white space."""
    return F.regexp_replace(c, f"[^A-Za-z0-9{SPACE}]", "")


# a code point that is no character, so texts do not hold it
MARK = "\ufdd0"


def title(c: Column) -> Column:
    """Capital first letter of every run of letters.

    ``initcap`` starts words at blanks only, so a mark and a blank go before every run and come out again.
    """
    marked = F.regexp_replace(c, r"\p{L}+", MARK + " $0")
    quick = F.replace(F.initcap(marked), F.lit(MARK + " "), F.lit(""))
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    careful = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(F.contains(c, F.lit(MARK)), careful).otherwise(quick)


def is_blank(c: Column) -> Column:
    return (c != "") & (strip(c) == "")


def quote(literal: str) -> str:
    """Regular expression that matches ``literal`` itself."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|&" else ch for ch in literal)
