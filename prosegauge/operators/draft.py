"""A draft dictionary from the words that documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.sources.lexicon import ALTERNATIVE

WORD = "[A-Za-z]{2,}"
ENDING = "^([a-z]{3,}?)(ing|ed|es|e)$|^([a-z]{2,}?[a-rt-z])s$"
ONE_IN = 500
APPROVED_ONE_IN = 50


def shared_words(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(word, docs, of): words that at least two documents and one in ``one_in`` hold, of how many.

    There are at most ``one_in`` times as many as a document has different
    words on average, whatever the number of documents.
    """
    each = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    of = docs.agg(F.count(F.lit(1))).first()[0]
    held = docs.select(F.explode(each).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return held.where((F.col("docs") >= 2) & (F.col("docs") * one_in >= of)).withColumn("of", F.lit(of))


def draft_entries(docs: DataFrame, one_in: int = ONE_IN, approved_one_in: int = APPROVED_ONE_IN) -> DataFrame:
    """Dictionary entries with seq, in the order of their headwords, for an editor to go on with.

    Words that differ in an ending are one entry, under the one that most
    documents hold; it is a verb if one of them ends so, else a noun. It is
    approved if one in ``approved_one_in`` documents holds its headword; else
    its alternative is the approved entry of its kind with the same first three
    letters that most documents hold, if there is one. Ties go by the word.

    Null texts have no words but count as documents; repeated rows count each
    time; an empty table gives no entry. Only text is read.
    """
    words = shared_words(docs, one_in).withColumn("stem", F.regexp_replace("word", ENDING, "$1$3"))
    verb = F.max(F.col("word").rlike("^[a-z]{3,}(ing|ed)$"))
    held = words.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct((-F.col("docs")).alias("less"), "word"))).alias("ws"), F.max("docs").alias("docs"), F.max("of").alias("of"), F.when(verb, "v").otherwise("n").alias("pos"))
    heads = held.select(F.element_at("ws", 1)["word"].alias("head"), F.transform(F.array_sort(F.transform(F.slice("ws", 2, F.size("ws")), lambda w: w["word"])), F.upper).alias("forms"), "pos", "docs", "of", (F.col("docs") * approved_one_in >= F.col("of")).alias("approved"), F.substring(F.element_at("ws", 1)["word"], 1, 3).alias("start"))
    instead = heads.where("approved").groupBy("start", "pos").agg(F.min_by(F.upper("head"), F.struct(-F.col("docs"), "head")).alias("instead"))
    alt = F.struct(F.col("instead").alias("word"), F.col("pos"), F.lit("").alias("ste_example"), F.lit("").alias("non_ste_example"))
    got = heads.join(instead, ["start", "pos"], "left")
    return got.select(
        F.row_number().over(Window.orderBy("head")).alias("seq"),  # as many as shared_words at most
        F.when(F.col("approved"), F.upper("head")).otherwise(F.col("head")).alias("headword"), "pos", "approved", "forms", F.concat("docs", F.lit(" of "), "of", F.lit(" documents")).alias("note"), F.lit(None).cast("string").alias("definition"),
        F.when(~F.col("approved") & F.col("instead").isNotNull(), F.array(alt)).otherwise(F.expr(f"cast(array() as array<{ALTERNATIVE}>)")).alias("alternatives"), F.expr("cast(array() as array<string>)").alias("examples"), F.lit(None).cast("int").alias("page"),
    )
