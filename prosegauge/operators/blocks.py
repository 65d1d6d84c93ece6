"""Long documents as many tasks: blocks of lines with states that compose.

A text is dealt out in windows of bytes and cut behind line feeds, so a block
holds whole lines: what stands between a window's first and last line feed,
or the one line that runs over the ends of windows. A block is read without
knowing what came before it, up to what a few facts decide: code that is
open, a blank line, a sentence that is open. Those facts are summed up for
each block, and a prefix over the blocks of a document gives what each is
entered with. Only sentences at the ends of blocks are put together.

A line is the limit of the split: it is cleaned as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.functions.arrays import places
from prosegauge.functions.constants import FENCE
from prosegauge.functions.text import once, strip
from prosegauge.operators.lines import DOC, numbered, with_lines, with_raw
from prosegauge.operators.sentences import sentences, with_paragraphs, with_parts, with_sents
from prosegauge.sources.texts import written

BLOCK_BYTES = 1 << 20
KEY = (*DOC, "block")


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_row, doc_id, w, data): each text's bytes in windows, dealt over all tasks."""
    data = F.encode("text", "UTF-8")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("text") / size).cast("int")), lambda i: F.substring(data, i * size + 1, F.lit(size)))
    return docs.select(*DOC, F.posexplode(parts).alias("w", "data")).repartition("doc_row", "w")


def blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(doc_row, doc_id, block, text): whole lines, in order of block, which together are the document."""
    # where the first and the last line feed of a window are; bytes as Latin-1 characters, so that places are bytes
    win = once(windows(docs, size), s=F.decode("data", "ISO-8859-1"))
    win = once(win, first=F.instr("s", "\n"), last=F.length("s") - F.length(F.substring_index("s", "\n", -1)))
    inner = win.where("last > first").select(*DOC, (2 * F.col("w")).alias("block"), F.expr("substring(data, first + 1, last - first)").alias("data"))
    # a line over ends of windows: the rest of the last window that has a line feed, whole windows, and the beginning of the next one that has
    ends = win.select(*DOC, "w", (F.col("first") > 0).alias("has"))
    before = Window.partitionBy("doc_row").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    opened = ends.withColumn("since", F.coalesce(F.max(F.when(F.col("has"), F.col("w"))).over(before), F.lit(-1))).select(F.col("doc_row").alias("__row"), F.col("w").alias("__w"), "since")
    at = win.join(opened, (F.col("doc_row") == F.col("__row")) & (F.col("w") == F.col("__w")))
    piece = lambda since, data: F.struct(since.alias("since"), data.alias("data"))
    head = piece(F.col("since"), F.when(F.col("first") > 0, F.expr("substring(data, 1, first)")).otherwise(F.col("data")))
    tail = F.when(F.col("first") > 0, piece(F.col("w"), F.expr("substring(data, last + 1)")))
    pieces = at.select(*DOC, "w", F.explode(F.array_compact(F.array(head, tail))).alias("p"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("w", "p.data"))), F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    lines = pieces.groupBy(*DOC, F.col("p.since").alias("since")).agg(joined.alias("data")).select(*DOC, (2 * F.col("since") + 1).alias("block"), "data")
    return inner.unionByName(lines).select(*KEY, F.col("data").cast("string").alias("text")).where("text <> ''")


def with_code(rows: DataFrame) -> DataFrame:
    """Add in_code: whether code is open where a block begins. A block gives the parity of its fences; those of odd parity before a block decide."""
    flips = with_raw(rows.where(F.col("text").contains("```")))
    flips = flips.select("doc_row", "block", (F.size(places("raw", lambda x, i: x.rlike(FENCE))) % 2).alias("flips")).where("flips = 1")
    turns = flips.groupBy("doc_row").agg(F.array_sort(F.collect_list("block")).alias("turns")).select(F.col("doc_row").alias("__row"), "turns")
    out = rows.join(turns, F.col("doc_row") == F.col("__row"), "left")
    open_ = F.size(F.filter("turns", lambda b: b < F.col("block"))) % 2
    return out.withColumn("in_code", F.coalesce(F.when(F.col("turns").isNotNull(), open_), F.lit(0))).drop("__row", "turns")


def first(c: str) -> Column:
    return F.get(c, F.lit(0))


def read(rows: DataFrame, fix_quirks: bool) -> DataFrame:
    """KEY, sents and what sums a block up, as if a document began with it."""
    rows = once(with_lines(rows), n_lines=F.size("lines"), head_block=first("lines")["starts_block"])
    rows = with_paragraphs(rows)
    rows = once(rows, head_blank=first("lines")["is_blank"], last_blank=F.element_at("lines", -1)["is_blank"], steps=F.element_at("lines", -1)["paragraph"])
    rows = with_parts(rows, fix_quirks)
    rows = once(rows, n_parts=F.size("parts"), runs_on=(first("parts")["line"] == 1) & ~F.col("head_block"), last_ends=F.try_element_at("parts", F.lit(-1))["ends"])
    return with_sents(rows).select(*KEY, "sents", F.struct(*SUMMED, F.size("sents").alias("n_sents")).alias("sum"))


SUMMED = ("block", "n_lines", "head_block", "head_blank", "last_blank", "steps", "n_parts", "runs_on", "last_ends")
ENTRY = "struct<block:int,line:int,paragraph:int,sent:int,joins:boolean>"


def entered(read_blocks: DataFrame) -> DataFrame:
    """(doc_row, block, line, paragraph, sent, joins): the counts that each block begins with, and whether its first sentence goes on from before.

    Blocks are composed in order; of each there is one small row.
    """
    zero = F.struct(F.lit(True).alias("blank"), F.lit(True).alias("ends"), F.lit(0).alias("line"), F.lit(0).alias("paragraph"), F.lit(0).alias("sent"), F.expr(f"cast(array() as array<{ENTRY}>)").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        shift = (~acc["blank"] & (b["head_blank"] | b["head_block"])).cast("int")
        joins = (b["n_parts"] > 0) & ~acc["ends"] & ~acc["blank"] & F.coalesce(b["runs_on"], F.lit(False))
        own = F.struct(b["block"].alias("block"), acc["line"].alias("line"), (acc["paragraph"] + shift).alias("paragraph"), (acc["sent"] - joins.cast("int")).alias("sent"), joins.alias("joins"))
        return F.struct(
            b["last_blank"].alias("blank"),
            F.when(b["n_parts"] > 0, b["last_ends"]).otherwise(acc["ends"]).alias("ends"),
            (acc["line"] + b["n_lines"]).alias("line"),
            (acc["paragraph"] + shift + b["steps"]).alias("paragraph"),
            (acc["sent"] + b["n_sents"] - joins.cast("int")).alias("sent"),
            F.concat(acc["out"], F.array(own)).alias("out"),
        )

    sums = read_blocks.groupBy("doc_row").agg(F.array_sort(F.collect_list("sum")).alias("sums"))
    return sums.select("doc_row", F.explode(F.aggregate("sums", zero, step, lambda acc: acc["out"])).alias("e")).select("doc_row", "e.*")


def sentences_of_long(docs: DataFrame, fix_quirks: bool = False, size: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``sentences`` for documents of any length, by blocks."""
    read_blocks = written(read(with_code(written(blocks(numbered(docs), size))), fix_quirks))
    start = entered(read_blocks).select(*(F.col(c).alias(f"__{c}") for c in ("doc_row", "block", "line", "paragraph", "sent", "joins")))
    rows = read_blocks.join(start, (F.col("doc_row") == F.col("__doc_row")) & (F.col("block") == F.col("__block")))
    rows = rows.select(*KEY, "__line", "__paragraph", "__sent", F.size("sents").alias("n"), F.explode("sents").alias("s"))
    rows = rows.select(*KEY, (F.col("s.sent_id") + F.col("__sent")).alias("sent_id"), (F.col("s.line") + F.col("__line")).alias("line"), "s.col", "s.text", (F.col("s.paragraph") + F.col("__paragraph")).alias("paragraph"), ((F.col("s.sent_id") == 1) | (F.col("s.sent_id") == F.col("n"))).alias("edge"))
    kept = [*DOC, "sent_id", "line", "col", strip(F.col("text")).alias("text"), "paragraph"]
    # the first and the last sentence of a block may be parts of one
    edges = rows.where("edge").groupBy(*DOC, "sent_id").agg(F.min_by(F.struct("line", "col", "paragraph"), "block").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " ").alias("text"))
    return rows.where("not edge").select(*kept).unionByName(edges.select(*DOC, "sent_id", "f.*", "text").select(*kept))


def split_sentences(docs: DataFrame, fix_quirks: bool = False, size: int = BLOCK_BYTES) -> DataFrame:
    """``sentences`` of any documents: those longer than a block are dealt out, the others are folded in their rows."""
    docs, long = numbered(docs), F.octet_length("text") > size
    return sentences(docs.where(~long), fix_quirks).unionByName(sentences_of_long(docs.where(long), fix_quirks, size))
