"""Fill-in-the-middle: texts cut at units into prefix, middle and suffix, by one regular expression with counted quantifiers.

``regexp_count`` gives the n units of a text, two draws give the numbers a <= b
of units before the cuts, and the row's own pattern

    \\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z

captures the three parts in one match; the replacement puts them in their new
order behind their markers. A counted possessive group matches in a loop
without a stack and never gives a unit back, so a text of any length is matched
in one pass. All of it is built-in functions on one row: nothing is shuffled and
no Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

#: A line with its end, or the last one without; the pattern must hold no group that captures.
LINE = r"[^\n]*\n|[^\n]+"
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def draws(salt: str, key: Column, count: int) -> list[Column]:
    """``count`` (8 at most) unsigned 32-bit numbers as bigint: groups of eight digits of the hex sha256 of ``salt`` and the key's text."""
    if count > 8:
        raise ValueError("a hash has eight numbers")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]


def _checked(markers: Sequence[str]) -> Sequence[str]:
    """Markers that are found again wherever they were put: none can begin in a text and end in another marker, or the reverse."""
    if len(markers) != 3 or len(set(markers)) < 3 or any(other.startswith(one[i:]) or one in other[1:] for one in markers for other in markers for i in range(1, len(one))) or not all(markers):
        raise ValueError("three markers are needed, of which no end is the beginning of one and none holds another")
    return markers


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def fill_in_middle(
    docs: DataFrame,
    unit: str = LINE,
    rate: int = 100,
    spm: int = 50,
    salt: str = "7:",
    markers: Sequence[str] = MARKERS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n bigint, form, prefix_chars, middle_chars bigint, output) of every row of ``docs``.

    n: units of the text; the prefix ends behind the smaller, the middle behind
    the larger of two draws from 0..n, both fixed by ``salt`` and the id. Of a
    hundred texts ``rate`` are transformed, and of a hundred of those ``spm``
    get the form spm: suffix, prefix, middle; the others psm: prefix, suffix,
    middle. Null counts as empty. Empty texts, texts that hold a marker, and
    those not drawn stay as they are: form plain, and both lengths (in code
    points) null. A null id draws as an empty one; repeated rows are alike.
    Other columns are not read.
    """
    prefix, suffix, middle = _checked(markers)
    rows = columns_of(docs, [id_col, text_col]).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    one, two, drawn, shape = draws(salt, F.col("_id"), 4)
    rows = rows.select("_id", "_text", F.regexp_count("_text", F.lit(unit)).cast("bigint").alias("n"), one.alias("_one"), two.alias("_two"), drawn.alias("_drawn"), shape.alias("_shape"))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(F.col("_text"), F.lit(marker))
    plain = (F.col("_text") == "") | marked | (F.col("_drawn") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_shape") % 100 < spm, "spm").otherwise("psm")
    a, b = F.least(F.col("_one") % (F.col("n") + 1), F.col("_two") % (F.col("n") + 1)), F.greatest(F.col("_one") % (F.col("n") + 1), F.col("_two") % (F.col("n") + 1))
    rows = rows.select("_id", "_text", "n", form.alias("form"), a.alias("_a"), b.alias("_b"))
    group = f"((?:{unit}){{"
    pattern = F.concat(F.lit(f"\\A(?s:{group}"), F.col("_a"), F.lit(f"}}+){group}"), F.col("_b") - F.col("_a"), F.lit("}+)(.*))\\z"))
    p, s, m = map(_replacement, markers)
    rows = rows.withColumn("_pattern", pattern).withColumn(
        "output",
        F.when(F.col("form") == "psm", F.regexp_replace("_text", F.col("_pattern"), F.lit(f"{p}$1{s}$3{m}$2")))
        .when(F.col("form") == "spm", F.regexp_replace("_text", F.col("_pattern"), F.lit(f"{s}$3{p}$1{m}$2")))
        .otherwise(F.col("_text")),
    )
    # no text holds a marker, so the first one of each kind is the one that was put there, also next to parts of one
    at = {x: F.locate(x, F.col("output")) for x in markers}
    length = F.length("output")
    prefix_chars = F.when(F.col("form") == "psm", at[suffix] - at[prefix]).when(F.col("form") == "spm", at[middle] - at[prefix]) - len(prefix)
    middle_chars = F.when(F.col("form") != "plain", length - at[middle] - len(middle) + 1)
    return rows.select(F.col("_id").alias(id_col), "n", "form", prefix_chars.cast("bigint").alias("prefix_chars"), middle_chars.cast("bigint").alias("middle_chars"), "output")


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, from nothing but output and form."""
    p, s, m = map(re.escape, _checked(markers))
    psm, spm = f"\\A(?s){p}(.*?){s}(.*?){m}(.*)\\z", f"\\A(?s){s}(.*?){p}(.*?){m}(.*)\\z"
    # psm: prefix, suffix, middle; spm: suffix, prefix, middle
    return F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2")).when(form == "spm", F.regexp_replace(output, spm, "$2$3$1")).otherwise(output)
