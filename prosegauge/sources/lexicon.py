"""Dictionaries and term lists as one lexicon.

A dictionary is an input of fixed size, a few thousand entries; ``Lexicon``
checks that bound when it brings one to the driver, where its sets become
constants of the column expressions and its table is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.constants import CLOSED_CLASS, NOUN_LIKE

MOST_ENTRIES = 200_000
ALTERNATIVE = "struct<word:string,pos:string,ste_example:string,non_ste_example:string>"
ENTRY = f"headword string, pos string, approved boolean, forms array<string>, note string, definition string, alternatives array<{ALTERNATIVE}>, examples array<string>, page int"
DICTIONARY = f"source string, entry_count int, approved_forms map<string,array<string>>, entries array<struct<{', '.join(':'.join(x.strip().split(' ', 1)) for x in ENTRY.split(', '))}>>"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a dictionary file, one row each, in the file's order (seq). A missing file says what is needed."""
    try:
        rows = spark.read.schema(DICTIONARY).json(path, multiLine=True)
    except AnalysisException as e:
        raise FileNotFoundError(f"no dictionary at {path}: build one, or name a file in its JSON form") from e
    return rows.select(F.posexplode("entries").alias("seq", "e")).select("seq", "e.*")


def parse_terms(lines: DataFrame) -> DataFrame:
    """Distinct terms of ``lines(value)``: what follows # goes, blanks go, case stays."""
    term = F.trim(F.element_at(F.split("value", "#"), 1))
    return lines.select(term.alias("term")).where("term <> ''").distinct()


def read_terms(spark: SparkSession, *paths: str) -> DataFrame:
    """Terms of any number of files; a missing one is named."""
    try:
        return parse_terms(spark.read.text(list(paths)))
    except AnalysisException as e:
        raise FileNotFoundError(f"no list of terms at one of {', '.join(paths)}") from e


#: Terms of this engine's own field, which every check admits unless it is told not to.
DEFAULT_TERMS = ("batch", "broadcast", "bucket", "cluster", "column", "corpus", "dataset", "driver", "executor", "join", "lexicon", "partition", "query", "schema", "shuffle", "stream", "token", "DataFrame", "Parquet", "Spark", "SQL")


def with_default_terms(terms: DataFrame | None, spark: SparkSession, default: bool = True) -> DataFrame:
    """Distinct terms: the default ones, unless ``default`` is false, and those given."""
    own = spark.createDataFrame([(t,) for t in DEFAULT_TERMS if default], "term string")
    return own if terms is None else own.unionByName(terms.select("term")).distinct()


def approved_forms(entries: DataFrame) -> DataFrame:
    """(surface, pos): each word of an approved headword or form, with the parts of speech it is approved as."""
    words = entries.where("approved").select("pos", F.explode(F.concat(F.array("headword"), F.coalesce("forms", F.expr("cast(array() as array<string>)")))).alias("form"))
    each = words.select(F.coalesce("pos", F.lit("phrase")).alias("pos"), F.explode(F.regexp_extract_all("form", F.lit("[A-Za-z][A-Za-z'-]*"), 0)).alias("surface"))
    return each.groupBy(F.lower("surface").alias("surface")).agg(F.array_sort(F.collect_set("pos")).alias("pos"))


def is_folded(term: Column) -> Column:
    """Terms in lower case match any case; a term with a capital, or with no cased letter, matches as written."""
    return term.rlike(r"\p{Ll}") & ~term.rlike(r"[\p{Lu}\p{Lt}]")


def lexicon_rows(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each lower-case surface, with all that the rules ask of it."""
    own = entries.withColumns({"key": F.lower("headword"), "forms": F.coalesce("forms", F.expr("cast(array() as array<string>)")), "alternatives": F.coalesce("alternatives", F.expr(f"cast(array() as array<{ALTERNATIVE}>)"))})
    label = lambda a: F.when(a["pos"].isNotNull() & (a["pos"] != ""), F.concat(a["word"], F.lit(" ("), a["pos"], F.lit(")"))).otherwise(a["word"])
    labels = F.when(F.size("alternatives") > 0, F.transform("alternatives", label)).when(F.coalesce("note", F.lit("")) != "", F.array("note")).otherwise(F.expr("cast(array() as array<string>)"))
    bad = own.where("not approved").withColumn("labels", labels)
    bad = bad.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "labels", "alternatives"))).alias("e"))
    words = F.flatten(F.transform("e", lambda x: F.transform(x["alternatives"], lambda a: a["word"])))
    bad = bad.select(
        "key",
        F.filter(F.transform("e", lambda x: x["pos"]), lambda p: p.isNotNull() & (p != "")).alias("bad_pos"),
        F.array_distinct(F.flatten(F.transform("e", lambda x: x["labels"]))).alias("labels"),
        F.array_sort(F.array_distinct(words)).alias("alt_words"),
        F.exists(words, lambda w: F.lower(w) == F.col("key")).alias("self_alternative"),
    )
    surfaces = own.select("pos", "approved", "seq", F.explode(F.transform(F.concat(F.array("headword"), "forms"), F.lower)).alias("key"))
    every = surfaces.groupBy("key").agg(F.collect_set(F.coalesce("pos", F.lit(""))).alias("all_pos"))
    parts = own.where((F.size("forms") > 0) & F.col("approved") & (F.col("pos") == "v")).select(F.lower(F.element_at("forms", -1)).alias("key")).distinct().withColumn("participle", F.lit(True))
    folded = terms.where(is_folded(F.col("term"))).select(F.lower("term").alias("key")).distinct().withColumn("domain", F.lit(True))
    written = terms.where(~is_folded(F.col("term"))).groupBy(F.lower("term").alias("key")).agg(F.array_sort(F.collect_set("term")).alias("as_written"))
    good = approved_forms(entries).withColumnRenamed("surface", "key").withColumnRenamed("pos", "good_pos")
    out = every.join(good, "key", "full").join(bad, "key", "full").join(parts, "key", "full").join(folded, "key", "full").join(written, "key", "full")
    strings = F.expr("cast(array() as array<string>)")
    out = out.select("key", *(F.coalesce(c, strings).alias(c) for c in ("all_pos", "good_pos", "labels", "alt_words", "as_written")), F.coalesce("bad_pos", strings).alias("bad_pos"), F.col("bad_pos").isNotNull().alias("unapproved"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("self_alternative", "participle", "domain")))
    has = lambda *p: F.arrays_overlap("all_pos", F.array(*map(F.lit, p)))
    return out.withColumns(
        {
            "verb": has("v"),
            "noun_like": has(*NOUN_LIKE),
            "closed": has(*CLOSED_CLASS) | (F.col("all_pos") == F.array(F.lit("adv"))),
            "approved": F.size("good_pos") > 0,
            "collision": F.col("domain") & F.col("unapproved"),
        }
    )


@dataclass
class Lexicon:
    rows: DataFrame
    words: dict[str, dict]
    cased: tuple[str, ...]
    domain_phrases: tuple[str, ...]
    bad_phrases: tuple[str, ...]

    @classmethod
    def build(cls, entries: DataFrame, terms: DataFrame) -> Lexicon:
        """Entries need headword, pos, approved, forms, note, alternatives; seq is their order (else that of the rows)."""
        if "seq" not in entries.columns:
            entries = entries.withColumn("seq", F.monotonically_increasing_id())
        rows = lexicon_rows(entries, terms).orderBy("key").limit(MOST_ENTRIES + 1).collect()
        listed = [r.term for r in terms.select("term").distinct().orderBy("term").limit(MOST_ENTRIES + 1).collect()]
        if len(rows) > MOST_ENTRIES or len(listed) > MOST_ENTRIES:
            raise ValueError(f"a dictionary of more than {MOST_ENTRIES} words cannot be broadcast")
        spark = entries.sparkSession
        schema = lexicon_rows(entries, terms).schema
        words = {r.key: r.asDict() for r in rows}
        order = {r.key: i for i, r in enumerate(entries.where("not approved").select(F.lower("headword").alias("key"), "seq").orderBy("seq").collect()[::-1])}
        by_words = lambda p: -len(p.split())
        bad = sorted(sorted((k for k, w in words.items() if " " in k and w["unapproved"]), key=lambda k: -order.get(k, 0)), key=by_words)
        folded = lambda t: any(ch.islower() for ch in t) and not any(ch.isupper() or ch.istitle() for ch in t)
        return cls(spark.createDataFrame(rows, schema), words, tuple(t for t in listed if not folded(t)), tuple(sorted({t.lower() for t in listed if " " in t}, key=by_words)), tuple(bad))

    @cached_property
    def phrases(self) -> DataFrame:
        """Terms and disallowed words of several words: (first_word, rank, phrase, kind, lead), lead being what stands before that word."""
        listed = [(i, p, k) for i, (p, k) in enumerate([*((p, "term") for p in self.domain_phrases), *((p, "bad") for p in self.bad_phrases)])]
        rows = self.rows.sparkSession.createDataFrame(listed, "rank int, phrase string, kind string")
        word = F.regexp_extract("phrase", r"(?U)\w+", 0)
        return rows.select(word.alias("first_word"), "rank", "phrase", "kind", (F.instr("phrase", word) - 1).alias("lead")).where("first_word <> ''")

    @property
    def longest_phrase(self) -> int:
        return max(map(len, (*self.domain_phrases, *self.bad_phrases)), default=0)

    def look_up(self, df: DataFrame, word: Column, *columns: str, prefix: str = "") -> DataFrame:
        """df with ``columns`` of the lexicon for each row's lower-case word, by one join with the broadcast table.

        Words that are not listed have nulls. The column listed says whether
        the word is a term: one in lower case in any case, others as written.
        """
        own = self.rows.select(F.col("key").alias("__key"), F.col("domain").alias("__domain"), F.col("as_written").alias("__written"), *(F.col(c).alias(prefix + c) for c in columns))
        out = df.join(F.broadcast(own), F.lower(word) == F.col("__key"), "left")
        listed = F.col("__domain") | F.array_contains("__written", word)
        return out.withColumn(f"{prefix}listed", F.coalesce(listed, F.lit(False))).drop("__key", "__domain", "__written")

    def inflected(self, suffixes, least_double: int = 3, noun_like: bool = True) -> DataFrame:
        """(form, stem): the surface forms that the verbs take by ``suffixes``, each with the stem that comes first in their order.

        A form loses its suffix, gains the ending, and may lose one of two like
        letters at its end; forms are made from the verbs by the way back.
        ``noun_like`` false leaves out verbs that are nouns or adjectives too.
        """
        verbs = self.rows.where("verb" if noun_like else "verb and not noun_like").select("key")
        key, options = F.col("key"), []
        for i, (suffix, ending) in enumerate(suffixes):
            for double in (0, 1):
                full = F.concat(key, F.right(key, F.lit(1))) if double else key
                form = F.concat(F.left(full, F.length(full) - len(ending)), F.lit(suffix))
                fits = full.endswith(ending) & (F.length(form) > len(suffix) + 1) & (F.length(key) >= 3)
                if double:
                    fits = fits & (F.length(full) > least_double)
                options.append(F.when(fits, F.struct(form.alias("form"), F.lit(2 * i + double).alias("rank"))))
        forms = verbs.select("key", F.explode(F.array_compact(F.array(*options))).alias("o"))
        return forms.groupBy("o.form").agg(F.min_by("key", "o.rank").alias("stem"))
