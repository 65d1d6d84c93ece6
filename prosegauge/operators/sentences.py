"""Lines to sentences and paragraphs, inside a document's row.

A running count of paragraphs, of sentences, or of parts between two ends is
the number of a run between marked places of an array, so no window and no
fold that copies its result is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.arrays import BLOCK, places, runs, sum_before, sums_before, total
from prosegauge.functions.constants import ABBREVIATIONS
from prosegauge.functions.text import blank, once, strip
from prosegauge.operators.lines import DOC, with_lines

CUT = "\x03"
TAIL = 10
PIECE = "struct<line:int,paragraph:int,fresh:boolean,k:int,text:string>"


def with_paragraphs(docs: DataFrame) -> DataFrame:
    """lines gain is_blank, fresh (nothing runs on into the line) and paragraph (from 0)."""
    docs = once(docs, empty=F.transform("lines", lambda x: blank(x["text"])))
    after = lambda i: (i == 0) | F.coalesce(F.get("empty", i - 1), F.lit(True))
    steps = places("lines", lambda x, i: ~after(i) & (F.get("empty", i) | x["starts_block"]))
    docs = once(docs, steps=F.concat(F.array(F.lit(1)), steps))
    own = lambda r, j: F.transform(r, lambda x, i: F.struct(x["text"].alias("text"), x["starts_block"].alias("starts_block"), j.alias("paragraph"), (F.get("steps", j) + i).alias("line_no")))
    docs = once(docs, own=F.flatten(F.transform(runs("lines", "steps"), own)))
    fresh = lambda x, i: after(i) | x["starts_block"]
    lines = F.transform("own", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), F.get("empty", i).alias("is_blank"), fresh(x, i).alias("fresh"), x["paragraph"].alias("paragraph")))
    return once(docs, lines=lines).drop("empty", "steps", "own")


def pieces_of(line: Column) -> Column:
    """A line cut after . ! ? : before white space or its end."""
    cut = F.split(F.regexp_replace(line["text"], r"(?U)([.!?:])(?=\s|$)", f"$1{CUT}"), CUT)
    return F.transform(cut, lambda p, k: F.struct(line["line_no"].alias("line"), line["paragraph"].alias("paragraph"), line["fresh"].alias("fresh"), k.alias("k"), p.alias("text")))


def with_parts(docs: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """Add parts: what each line adds to the running sentence, in order: (line, col, paragraph, fresh, text, ends).

    After an abbreviation no sentence ends, and the next part starts again
    where this one did, so its words are given twice; fix_quirks gives them
    once.
    """
    none = F.expr(f"cast(array() as array<{PIECE}>)")
    docs = once(docs, pieces=F.flatten(F.transform("lines", lambda x: F.when(x["is_blank"], none).otherwise(pieces_of(x)))))
    last = lambda i: F.coalesce(F.get("pieces", i + 1)["k"] == 0, F.lit(True))
    # an abbreviation, its period and what stands before it are within the last characters of a piece
    guarded = lambda p: p["text"].endswith(".") & F.right(p["text"], F.lit(TAIL)).rlike(rf"(?U)\b{ABBREVIATIONS}\.$")
    docs = once(docs, ends=F.transform("pieces", lambda p, i: ~last(i) & ~guarded(p)), sizes=F.transform("pieces", lambda p: F.length(p["text"])))
    docs = once(docs, sums=sums_before("sizes"), starts=places("pieces", lambda p, i: (p["k"] == 0) | F.get("ends", i - 1)))
    where = lambda i: sum_before("sizes", "sums", i)

    def part(group: Column, first: Column, p: Column, i: Column) -> Column:
        # a group has more than one piece only where an abbreviation stands
        text = F.when(i == 0, p["text"]).otherwise(F.array_join(F.transform(F.slice(group, 1, i + 1), lambda x: x["text"]), ""))
        k = F.get(group, F.lit(0))["k"]
        at = F.when(k < BLOCK, total(F.slice("sizes", first - k + 1, k))).otherwise(where(first) - where(first - k))
        return F.struct(p["line"].alias("line"), at.alias("at"), F.length(F.regexp_extract(text, r"(?U)^\s*", 0)).alias("lead"), F.length(text).alias("size"), p["paragraph"].alias("paragraph"), p["fresh"].alias("fresh"), text.alias("text"), F.get("ends", first + i).alias("ends"), (last(first + i) | ~guarded(p) if fix_quirks else F.lit(True)).alias("whole"))

    grouped = F.transform(runs("pieces", "starts"), lambda g, j: F.transform(g, lambda p, i: part(g, F.get("starts", j) - 1, p, i)))
    given = lambda p: (p["lead"] < p["size"]) & p["whole"]
    parts = F.transform(F.filter(F.flatten(grouped), given), lambda p: F.struct(p["line"].alias("line"), (p["at"] + p["lead"] + 1).cast("int").alias("col"), p["paragraph"].alias("paragraph"), p["fresh"].alias("fresh"), p["text"].alias("text"), p["ends"].alias("ends")))
    return once(docs, parts=parts).drop("pieces", "ends", "sizes", "sums", "starts")


def with_sents(docs: DataFrame) -> DataFrame:
    """Add sents, made of parts: (sent_id, line, col, text, paragraph), the text with the blanks at its ends."""
    new = lambda p, i: (i == 0) | F.get("parts", i - 1)["ends"] | (p["fresh"] & (F.get("parts", i - 1)["line"] != p["line"]))
    docs = once(docs, starts=places("parts", new))
    joined = lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))["text"]).otherwise(F.array_join(F.transform(r, lambda p: p["text"]), " "))
    head = lambda r, c: F.get(r, F.lit(0))[c].alias(c)
    sents = F.transform(runs("parts", "starts"), lambda r, j: F.struct((j + 1).alias("sent_id"), head(r, "line"), head(r, "col"), joined(r).alias("text"), head(r, "paragraph")))
    return once(docs, sents=sents).drop("parts", "starts")


def with_sentences(docs: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """(doc_row, doc_id, text, sents): the sentences of each document as (sent_id, line, col, text, paragraph)."""
    docs = with_sents(with_parts(with_paragraphs(with_lines(docs)), fix_quirks))
    own = F.transform("sents", lambda x: F.struct(*(strip(x[c]).alias(c) if c == "text" else x[c].alias(c) for c in ("sent_id", "line", "col", "text", "paragraph"))))
    return docs.select(*DOC, "text", own.alias("sents"))


def sentences(docs: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """(doc_row, doc_id, sent_id, line, col, text, paragraph): one row for each sentence, without an exchange."""
    return with_sentences(docs, fix_quirks).select(*DOC, F.explode("sents").alias("s")).select(*DOC, "s.*")
