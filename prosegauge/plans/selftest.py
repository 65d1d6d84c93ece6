"""Whether the checker tells the good examples of a dictionary from its bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.plans.check import check_text, corpus_rate
from prosegauge.sources.lexicon import Lexicon

# --- fixed values: the gates and the sample ---
SAMPLE, SEED = 400, 11
MOST_IN_GOOD, LEAST_IN_BAD, APART, LONGEST = 0.015, 0.03, 2.0, 25
BAD_MARK = "(not STE)"


def examples(entries: DataFrame) -> DataFrame:
    """(good, text): every example sentence of a dictionary, of its alternatives and of its entries."""
    alts = entries.select(F.explode("alternatives").alias("a"))
    both = alts.select(F.lit(True).alias("good"), F.col("a.ste_example").alias("text")).unionByName(alts.select(F.lit(False).alias("good"), F.col("a.non_ste_example").alias("text")))
    marked = F.col("e").startswith(BAD_MARK)
    own = entries.select(F.explode("examples").alias("e")).select((~marked).alias("good"), F.when(marked, F.trim(F.substring("e", len(BAD_MARK) + 1, 1 << 30))).otherwise(F.col("e")).alias("text"))
    return both.unionByName(own).where("text <> ''")


def sample(rows: DataFrame, most: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows of each side, by a seeded hash of the text: the same ones in each run."""
    sides = [rows.where(F.col("good") == side).orderBy(F.xxhash64(F.lit(seed), "text"), "text").limit(most) for side in (True, False)]
    return sides[0].unionByName(sides[1])


def rates(rows: DataFrame, lex: Lexicon, mode: str = "auto") -> DataFrame:
    """(good, documents, sentences, words, violations, mean_sentence_words, max_sentence_words, violation_rate) of each side.

    Each example is a document of its own, so no sentence runs on into another.
    """
    got = check_text(rows.select(F.col("good").alias("doc_id"), "text"), lex, mode, keep=True)
    return corpus_rate(got.stats, "doc_id").withColumnRenamed("doc_id", "good")


def gates(rates_: DataFrame) -> DataFrame:
    """(name, status): the separation that a working checker shows."""
    r = rates_.agg(*(F.max(F.when(F.col("good") == side, F.col(c))).alias(f"{name}_{c}") for side, name in ((True, "good"), (False, "bad")) for c in ("violation_rate", "max_sentence_words")))
    tests = {
        f"at most {MOST_IN_GOOD:.1%} of words in good text": F.col("good_violation_rate") <= MOST_IN_GOOD,
        f"at least {LEAST_IN_BAD:.0%} of words in bad text": F.col("bad_violation_rate") >= LEAST_IN_BAD,
        f"bad text over {APART:g} times good text": F.col("bad_violation_rate") > APART * F.col("good_violation_rate"),
        f"good sentences of at most {LONGEST} words": F.col("good_max_sentence_words") <= LONGEST,
    }
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.when(v, "ok").otherwise("fail").alias("status")) for k, v in tests.items()))
    return r.select(F.explode(rows).alias("g")).select("g.*")
