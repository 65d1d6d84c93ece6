"""Stored sketches of words: small tables that merge, in place of the text.

Distinct words are estimated by HyperLogLog sketches with 2 ** LOG_SIZE
registers. Their relative standard error is about 1.04 over the root of
that number; ``BOUND`` is four times as much, which an estimate leaves less
often than once in ten thousand. Frequent words are tracked by sketches of at
most ``TRACKED`` words; an estimated count is above the true one by no more
than 4 / TRACKED of all words of the group (``top_bound``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.text import words_of

LOG_SIZE = 12
BOUND = 4 * 1.04 / 2 ** (LOG_SIZE / 2)
TRACKED = 4096


def words(sents: DataFrame, *by: str) -> DataFrame:
    return sents.select(*by, F.explode(F.transform(words_of(F.col("text")), F.lower)).alias("word"))


def word_sketches(each: DataFrame, *by: str) -> DataFrame:
    """(by, n_words, distinct_words, top_words): one row for each group, of bounded size, to be stored."""
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), F.hll_sketch_agg("word", LOG_SIZE).alias("distinct_words"), F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("top_words"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups, or with no ``by`` of all, from those of smaller ones; the text is not read."""
    return sketches.groupBy(*by).agg(F.sum("n_words").alias("n_words"), F.hll_union_agg("distinct_words").alias("distinct_words"), F.expr(f"approx_top_k_combine(top_words, {TRACKED})").alias("top_words"))


def estimates(sketches: DataFrame, top: int = 10) -> DataFrame:
    """Each sketch's estimates: distinct (of words), top (word and count), and top_bound, by how much such a count may be too high."""
    rest = [c for c in sketches.columns if c not in ("distinct_words", "top_words")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_words").alias("distinct"), F.expr(f"approx_top_k_estimate(top_words, {top})").alias("top"), F.ceil(4 * F.col("n_words") / TRACKED).alias("top_bound"))
