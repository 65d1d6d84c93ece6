"""Documents to cleaned lines.

The order of a document's lines is that of the array they stand in, so a
document is worked on inside its row: nothing is exchanged, sorted or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.arrays import places, runs
from prosegauge.functions.constants import BLOCK, FENCE, ITEM, LINE_BREAK, SEPARATOR, TABLE_ROW
from prosegauge.functions.text import hide_block, inline_clean, once, strip

#: What names a document: the number of its row, so that rows with one id, or none, stay apart; and its id.
DOC = ("doc_row", "doc_id")

#: What a part of a document, as ``operators.blocks`` makes them, brings: its number and whether code is open where it begins.
STATE = ("block", "in_code")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_row, the number of each row where it is read; a doc_row of the caller's own is kept.

    Rows that come in another order when they are computed again, as after a
    shuffle, need ``sources.texts.settled`` first, which ``check_text`` asks
    for by itself.
    """
    return docs if "doc_row" in docs.columns else docs.withColumn("doc_row", F.monotonically_increasing_id())


def with_raw(docs: DataFrame) -> DataFrame:
    """(doc_row, doc_id, text, raw): the lines of each text; a break at the end of a text opens no line."""
    parts = once(numbered(docs).select(*DOC, *(c for c in STATE if c in docs.columns), "text"), parts=F.split("text", LINE_BREAK))
    raw = F.when(F.element_at("parts", -1) == "", F.slice("parts", 1, F.size("parts") - 1)).otherwise(F.col("parts"))
    return once(parts, raw=raw).drop("parts")


def with_fences(docs: DataFrame) -> DataFrame:
    """Add fences: for each line of raw, whether it opens or closes a block of code (fence), and whether code is open after it (inside).

    Null for texts without a fence, which are most. Lines between two fences
    are a run, and every other run is code.
    """
    entered = F.col("in_code") if "in_code" in docs.columns else F.lit(0)
    marks = F.when(F.col("text").contains("```") | (entered > 0), places("raw", lambda x, i: x.rlike(FENCE)))
    docs = once(docs, marks=F.concat(F.array(F.lit(1)), marks))
    inside = lambda r, j: F.transform(r, lambda x, i: F.struct(((j > 0) & (i == 0)).alias("fence"), ((j + entered) % 2 == 1).alias("inside")))
    return once(docs, fences=F.when(F.size("marks") > F.when(entered > 0, 0).otherwise(1), F.flatten(F.transform(runs("raw", "marks"), inside)))).drop("marks")


def is_row(raw: Column) -> Column:
    """Whether a line is a row of a table."""
    return raw.contains("|") & raw.rlike(TABLE_ROW) & (F.length(raw) - F.length(F.replace(raw, F.lit("|"), F.lit(""))) >= 2)


def cleaned(raw: Column, inline: Column, gone: Column) -> Column:
    """(text, starts_block) of a line: its prose, with code, links, marks and table rules taken out.

    ``inline`` is the line without inline code and addresses. What few lines
    need is asked for by a plain search first.
    """
    rule = raw.contains("|") & raw.contains("-") & strip(raw).rlike(SEPARATOR)
    row = is_row(raw)
    inner = F.regexp_replace(strip(inline), r"^\|+|\|+$", "")
    cells = F.filter(F.transform(F.split(inner, r"\|"), lambda c: F.replace(strip(c), F.lit(":"), F.lit(" "))), lambda c: c != "")
    cells = F.when(F.size(cells) > 0, F.concat(F.array_join(cells, ". "), F.lit("."))).otherwise("")
    shown = F.when(inline.rlike(BLOCK), hide_block(inline)).otherwise(inline)
    prose = F.when(inline.rlike("[*_>|]"), F.translate(shown, "*_>|", "    ")).otherwise(shown)
    prose = F.when(~inline.contains(":") | raw.rlike(ITEM), prose).otherwise(F.replace(prose, F.lit(":"), F.lit(" ")))
    text = F.when(gone | rule, "").when(row, cells).otherwise(prose)
    block = F.when(gone | rule, False).when(row, True).otherwise(raw.rlike(BLOCK))
    return F.struct(text.alias("text"), block.alias("starts_block"))


def with_lines(docs: DataFrame) -> DataFrame:
    """Add lines, the (text, starts_block) of each line of a text, to (doc_row, doc_id, text)."""
    docs = once(with_fences(with_raw(docs)), inline=F.transform("raw", inline_clean))
    hidden = lambda i: F.coalesce(F.get("fences", i)["fence"] | F.get("fences", i)["inside"], F.lit(False))
    return once(docs, lines=F.transform("raw", lambda x, i: cleaned(x, F.get("inline", i), hidden(i)))).drop("inline", "fences", "raw")


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_row, doc_id, line_no from 1, raw)."""
    return with_raw(docs).select(*DOC, F.posexplode("raw").alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def fenced(docs: DataFrame) -> DataFrame:
    """(doc_row, doc_id, line_no, raw, fence, in_fence)."""
    at = with_fences(with_raw(docs)).select(*DOC, "fences", F.posexplode("raw").alias("i", "raw"))
    here = F.get("fences", F.col("i"))
    return at.select(*DOC, (F.col("i") + 1).alias("line_no"), "raw", F.coalesce(here["fence"], F.lit(False)).alias("fence"), F.coalesce(here["inside"], F.lit(False)).alias("in_fence"))


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_row, doc_id, line_no, text, starts_block): one row for each line."""
    return with_lines(docs).select(*DOC, F.posexplode("lines").alias("i", "l")).select(*DOC, (F.col("i") + 1).alias("line_no"), "l.text", "l.starts_block")
