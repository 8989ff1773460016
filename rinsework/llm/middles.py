"""Fill-in-the-middle transformation by one match of a counted pattern per row.

``regexp_count`` gives the number n of units in a text; two draws name the cuts a <= b. A pattern built for the row,
``unit{a}`` and ``unit{b-a}`` as possessive groups and a group for the rest, captures prefix, middle and suffix in one
match, and the replacement puts them down in their new order. Possessive counted groups run as loops, so a text of any
length needs no deep stack. Everything is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a pattern without groups of its own that matches at least one character; the rest of a text that units
#: from its start on do not reach belongs to the suffix.
CODE_POINT = r"(?s:.)"
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Units counted with one match, so that counting makes few pieces of long texts.
BLOCK = 1024

PLAIN, PSM, SPM = "plain", "psm", "spm"


def _counted(text: Column, unit: str) -> Column:
    """Units from the start of the text on: whole blocks first, then those of what blocks leave."""
    blocks = rf"\G(?:{unit}){{{BLOCK}}}+"
    left = F.regexp_replace(text, blocks, "")
    return (F.regexp_count(text, F.lit(blocks)) * BLOCK + F.regexp_count(left, F.lit(rf"\G(?:{unit})"))).cast("long")


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _verbatim(text: str) -> str:
    """Text as it stands in a replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(text: str) -> str:
    """Text as it stands in a pattern."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from: marks occur once each, as texts that hold one stay plain."""
    p, s, m = map(_quoted, markers)
    psm = rf"\A{p}((?s:.*?)){s}((?s:.*?)){m}((?s:.*))\z"
    spm = rf"\A{s}((?s:.*?)){p}((?s:.*?)){m}((?s:.*))\z"
    return (
        F.when(form == PSM, F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == SPM, F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(output)
    )


def fill_in_middle(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    unit: str = CODE_POINT,
    markers: tuple[str, str, str] = MARKERS,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """One row per document: the input row as struct ``row``, n, form, prefix_chars, middle_chars and output.

    n is the number of units. h1 to h4 are the first four 8-digit groups of the hex sha256 of ``{seed}:{doc_id}``, read
    as unsigned integers. The prefix ends after min(h1 % (n+1), h2 % (n+1)) units, the middle after the larger. ``form``:
    plain (the text itself) where the text is empty, holds a marker, or by h3 for ``plain_percent`` of all; else spm by
    h4 for ``spm_percent``, else psm. ``psm`` is marked prefix, suffix, middle; ``spm`` marked suffix, prefix, middle.
    prefix_chars and middle_chars are in code points, null where plain.

    A null text counts as empty; a null doc_id draws by the seed alone. Rows are taken one by one: equal rows give
    equal results, no row moves between tasks, other columns only ride along in ``row``.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.`{doc_id}`").cast("string"), F.lit("")))
    rows = rows.select("row", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("body"), F.sha2(key, 256).alias("digest"))
    rows = rows.withColumn("n", _counted(F.col("body"), unit))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("body", F.lit(m))
    plain = (F.col("body") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= 100 - plain_percent)
    form = F.when(plain, PLAIN).when(_draw(F.col("digest"), 3) % 100 < spm_percent, SPM).otherwise(PSM)
    cuts = [_draw(F.col("digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.select("row", "body", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    pattern = F.concat(
        F.lit(rf"\A((?:{unit}){{"), F.col("a").cast("string"),
        F.lit(rf"}}+)((?:{unit}){{"), (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)((?s:.*))\z"),
    )
    p, s, m = map(_verbatim, markers)
    psm = F.regexp_replace("body", pattern, F.lit(f"{p}$1{s}$3{m}$2"))
    spm = F.regexp_replace("body", pattern, F.lit(f"{s}$3{p}$1{m}$2"))
    output = F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("body"))
    rows = rows.select("row", "n", "form", output.alias("output"))
    # where the marks stand in the output tells how long the pieces are
    at_p, at_s, at_m = (F.instr("output", F.lit(m)).cast("long") for m in markers)
    prefix = F.when(F.col("form") == PSM, at_s - at_p).when(F.col("form") == SPM, at_m - at_p) - len(markers[0])
    middle = F.when(F.col("form") != PLAIN, F.char_length("output") - at_m - (len(markers[2]) - 1))
    return rows.select(
        "row", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output"
    )
