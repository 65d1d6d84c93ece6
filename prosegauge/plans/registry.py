"""Registered queries, by name, and their DuckDB SQL.

Every query over text runs on all documents and, for what those never hold,
on the few texts of ``fixtures.TEXTS``, which both engines get as literals
with ids of their own.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge.functions import constants as C
from prosegauge.functions.arrays import total
from prosegauge.functions.text import controlled_words, once, rounded, strip, trim_edge, word_count, words_of
from prosegauge.operators import dictionary, lines, report, rules, sketches
from prosegauge.operators.asof import as_of
from prosegauge.operators.blocks import split_sentences
from prosegauge.operators.draft import APPROVED_ONE_IN, ENDING, ONE_IN, WORD, draft_entries
from prosegauge.operators.ranks import ranked
from prosegauge.operators.sentences import sentences, with_paragraphs, with_sentences
from prosegauge.plans import check, fixtures, oracle, recheck, selftest
from prosegauge.sources import html
from prosegauge.sources.texts import shared_folder, spread, written
from prosegauge.streaming.sessions import write_sessions
from prosegauge.sources.lexicon import DEFAULT_TERMS, Lexicon, approved_forms, parse_terms, with_default_terms


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(fixtures.texts(spark))


@lru_cache(maxsize=2)
def lexicon(spark: SparkSession) -> Lexicon:
    return fixtures.lexicon(spark, fixtures.FULL, fixtures.TERMS)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LITERAL = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {oracle.text(t)})" for i, t in fixtures.TEXTS) + ") AS d(doc_id, text)"
BASE = oracle.base(f"SELECT doc_id, text FROM documents UNION ALL ({LITERAL})")
LEX = BASE + oracle.lexicon(fixtures.FULL, fixtures.TERMS)
WORDS = LEX + oracle.ladder(fixtures.TERMS)
FOUND = LEX + oracle.findings(fixtures.FULL, fixtures.TERMS)
STATS = FOUND + oracle.statistics()


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def sents_of(spark, sf_dir):
    return sentences(documents(spark, sf_dir))


def dealt_sents(spark, sf_dir):
    """For what does more work on a sentence than finding it: these tables are files of one row group, so one task would have all."""
    return sentences(spread(lines.numbered(documents(spark, sf_dir))))


def shaped(spark, sf_dir, mode="descriptive"):
    return rules.with_shape(sents_of(spark, sf_dir), lexicon(spark), mode)


def plain_tokens(spark, sf_dir):
    return rules.tokens(rules.with_tokens(dealt_sents(spark, sf_dir)))


# --- lines and sentences ---------------------------------------------------------------


@query(BASE + "SELECT doc_id, line_no::INT AS line_no, raw FROM raws")
def lines_split(spark, sf_dir):
    return lines.raw_lines(documents(spark, sf_dir)).drop("doc_row")


@query(BASE + "SELECT doc_id, line_no::INT AS line_no, text, starts_block FROM lines")
def lines_cleaned(spark, sf_dir):
    return lines.clean_lines(documents(spark, sf_dir)).drop("doc_row")


@query(BASE + "SELECT doc_id, line_no::INT AS line_no, fence, inside AS in_fence FROM fences")
def code_fence(spark, sf_dir):
    return lines.fenced(documents(spark, sf_dir)).select("doc_id", "line_no", "fence", "in_fence")


@query(BASE + "SELECT doc_id, line_no::INT AS line_no, text FROM lines WHERE (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM cleaned WHERE is_row)")
def table_cells(spark, sf_dir):
    raw = lines.raw_lines(documents(spark, sf_dir)).where(lines.is_row(F.col("raw"))).select("doc_id", "line_no")
    return lines.clean_lines(documents(spark, sf_dir)).join(raw, ["doc_id", "line_no"]).select("doc_id", "line_no", "text")


@query(BASE + f"SELECT doc_id, sent_id, text FROM sents WHERE regexp_matches(text, '\\b{C.ABBREVIATIONS}\\.')")
def abbreviation_guard(spark, sf_dir):
    return sents_of(spark, sf_dir).where(F.col("text").rlike(rf"\b{C.ABBREVIATIONS}\.")).select("doc_id", "sent_id", "text")


@query(BASE + "SELECT doc_id, sent_id, line, col, text, paragraph FROM sents")
def sentence_segmentation(spark, sf_dir):
    return sents_of(spark, sf_dir).drop("doc_row")


@query(BASE + "SELECT doc_id, sent_id, line, col, text, paragraph FROM sents")
def sentences_by_blocks(spark, sf_dir):
    """Blocks of 4 kB here, so that these documents have several."""
    return split_sentences(documents(spark, sf_dir), size=1 << 12).drop("doc_row")


@query(BASE + "SELECT doc_id, line_no::INT AS line_no, paragraph::BIGINT AS paragraph, fresh FROM paras")
def paragraph_ids(spark, sf_dir):
    own = with_paragraphs(lines.with_lines(documents(spark, sf_dir))).select("doc_id", F.explode("lines").alias("l"))
    return own.select("doc_id", "l.line_no", F.col("l.paragraph").cast("long").alias("paragraph"), "l.fresh")


@query(BASE + f"SELECT doc_id, count(*) AS sentences, sum(n_words)::BIGINT AS counted_words, max(n_words)::BIGINT AS max_sentence_words, {oracle.exact_round('sum(n_words) / count(*)', 1)} AS mean_sentence_words FROM counted GROUP BY doc_id")
def word_count_stats(spark, sf_dir):
    n = once(with_sentences(documents(spark, sf_dir)), n=F.transform("sents", lambda x: controlled_words(x["text"]).cast("long")))
    out = n.select("doc_id", F.size("n").cast("long").alias("sentences"), total("n").alias("counted_words"), F.array_max("n").alias("max_sentence_words"))
    return out.where("sentences > 0").withColumn("mean_sentence_words", rounded(F.col("counted_words") / F.col("sentences"), 1))


# --- tokens ---------------------------------------------------------------------------------


@query(BASE + 'SELECT doc_id, sent_id, idx, word, "offset", prev_word FROM toks')
def token_offsets(spark, sf_dir):
    return plain_tokens(spark, sf_dir).select("doc_id", "sent_id", "idx", "word", "offset", "prev_word")


@query(BASE + "SELECT doc_id, count(*) AS words FROM toks GROUP BY doc_id")
def token_count(spark, sf_dir):
    n = with_sentences(documents(spark, sf_dir)).select("doc_id", F.transform("sents", lambda x: word_count(x["text"]).cast("long")).alias("n"))
    return n.select("doc_id", total("n").alias("words")).where("words > 0")


@query(BASE + "SELECT lower(word) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM toks GROUP BY 1")
def distinct_vocabulary(spark, sf_dir):
    each = dealt_sents(spark, sf_dir).select(*lines.DOC, F.explode(words_of(F.col("text"))).alias("word"))
    each = each.groupBy(F.lower("word").alias("word"), *lines.DOC).agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


# --- rules of one sentence -------------------------------------------------------------------

PLACE = ("doc_id", "line", "col")


def found(df, rule=None, *more):
    return (df if rule is None else df.where(F.col("rule") == rule)).select(*PLACE, *more)


def of_rule(condition: str, *more: str) -> str:
    return FOUND + f"SELECT {', '.join((*PLACE, *more))} FROM found WHERE {condition}"


@query(BASE + f"SELECT doc_id, line, col, n_words::INT AS n_words FROM counted WHERE n_words > {C.WORDS_DESCRIPTIVE}")
def rule_length(spark, sf_dir):
    return sents_of(spark, sf_dir).withColumn("n_words", controlled_words(F.col("text"))).where(F.col("n_words") > C.WORDS_DESCRIPTIVE).select(*PLACE, "n_words")


@query(BASE + f"SELECT doc_id, paragraph, count(*) AS n FROM sents GROUP BY ALL HAVING count(*) > {C.SENTENCES_PARAGRAPH}")
def rule_paragraph(spark, sf_dir):
    return sents_of(spark, sf_dir).groupBy(*lines.DOC, "paragraph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > C.SENTENCES_PARAGRAPH).drop("doc_row")


@query(BASE + "SELECT doc_id, line, (col + instr(text, ';') - 1)::INT AS col FROM sents WHERE contains(text, ';')")
def rule_semicolon(spark, sf_dir):
    return found(rules.shape_findings(shaped(spark, sf_dir), lexicon(spark)), "8.1")


@query(of_rule("seq = 12", "message"))
def rule_contraction(spark, sf_dir):
    return found(rules.shape_findings(shaped(spark, sf_dir), lexicon(spark)), "4.2", "message")


def verbs(spark, sf_dir):
    return rules.verb_findings(dealt_sents(spark, sf_dir), lexicon(spark))


@query(of_rule("seq = 6", "message"))
def rule_auxiliary(spark, sf_dir):
    return found(verbs(spark, sf_dir), "3.4", "message")


@query(of_rule("seq = 5", "message"))
def rule_progressive(spark, sf_dir):
    return found(verbs(spark, sf_dir).where("seq = 5"), None, "message")


@query(of_rule("seq = 4", "message"))
def rule_perfect(spark, sf_dir):
    return found(verbs(spark, sf_dir).where("seq = 4"), None, "message")


@query(of_rule("seq = 7", "severity", "message"))
def rule_passive(spark, sf_dir):
    return found(verbs(spark, sf_dir).where("seq = 7"), None, "severity", "message")


@query(FOUND + "SELECT doc_id, sent_id, procedural FROM proc")
def procedural_flag(spark, sf_dir):
    return shaped(spark, sf_dir, "auto").select("doc_id", "sent_id", "procedural")


@query(of_rule("seq = 10"))
def rule_two_instructions(spark, sf_dir):
    return found(rules.shape_findings(shaped(spark, sf_dir, "auto"), lexicon(spark)), "5.2")


@query(of_rule("seq = 9", "rule", "message"))
def rule_length_by_kind(spark, sf_dir):
    return found(rules.shape_findings(shaped(spark, sf_dir, "auto"), lexicon(spark)).where("seq = 9"), None, "rule", "message")


@query(of_rule("seq IN (15, 16, 17)", "rule", "message", "suggestion"))
def rule_safety(spark, sf_dir):
    docs = documents(spark, sf_dir).where(rules.may_have_labels(F.col("text")))
    return found(rules.safety_findings(lines.with_lines(docs)), None, "rule", "message", "suggestion")


@query(of_rule("seq = 13", "message"))
def rule_noun_cluster(spark, sf_dir):
    return found(rules.cluster_findings(dealt_sents(spark, sf_dir), lexicon(spark)), None, "message")


@query(of_rule("seq = 8", "message", "term"))
def rule_gerund(spark, sf_dir):
    return found(rules.gerund_findings(plain_tokens(spark, sf_dir), lexicon(spark)), None, "message", "term")


# --- vocabulary ----------------------------------------------------------------------------------


def word_verdicts(spark, sf_dir):
    return rules.word_findings(plain_tokens(spark, sf_dir), lexicon(spark))


def rung(name: str) -> str:
    return WORDS + f"SELECT doc_id, line, col, key AS term FROM rungs WHERE rung = '{name}'"


@query(rung("bad"))
def rule_unapproved(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir), "1.1", "term")


@query(rung("pos"))
def rule_pos_mismatch(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir), "1.2", "term")


@query(rung("unknown"))
def rule_unknown_word(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir).where(report.is_unknown()), None, "term")


@query(rung("noun"))
def rule_noun_usage(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir).where(F.col("message").contains("may be a noun")), None, "term")


@query(rung("term"))
def rule_term_collision(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir).where(F.col("message").contains("is a listed term")), None, "term")


@query(rung("british"))
def rule_british(spark, sf_dir):
    return found(word_verdicts(spark, sf_dir), "1.14", "term")


def phrases(spark, sf_dir):
    return rules.phrase_findings(rules.phrase_spans(dealt_sents(spark, sf_dir), lexicon(spark)), lexicon(spark))


@query(of_rule("seq = 2 AND rule = '1.1'", "message", "suggestion"))
def rule_phrase(spark, sf_dir):
    return found(phrases(spark, sf_dir), "1.1", "message", "suggestion")


@query(of_rule("seq = 2 AND rule = '9.3'", "message", "suggestion"))
def rule_phrasal_verb(spark, sf_dir):
    return found(phrases(spark, sf_dir), "9.3", "message", "suggestion")


@query(of_rule("seq = 1", "message", "suggestion", "term"))
def rule_phrase_collision(spark, sf_dir):
    return found(phrases(spark, sf_dir), "1.6", "message", "suggestion", "term")


# --- findings, statistics and reports ---------------------------------------------------------------


def checked(spark, sf_dir, both: bool = False, **options):
    return check.check_text(lines.numbered(documents(spark, sf_dir)), lexicon(spark), keep_findings=both, **options)


def said_by_rule(name: str):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ").alias(name)


@query(STATS + "SELECT doc_id, sentences, counted_words, max_sentence_words, words, mean_sentence_words, violations, advisories, unapproved_words, unapproved_rate, violations_by_rule, advisories_by_rule FROM stats")
def doc_stats(spark, sf_dir):
    got = checked(spark, sf_dir).stats
    return got.select(*(said_by_rule(c) if c.endswith("_by_rule") else F.col(c) for c in got.columns if c != "doc_row"))


@query(FOUND + "SELECT doc_id, line, col, rule, message, suggestion, severity, term FROM found")
def findings(spark, sf_dir):
    return checked(spark, sf_dir).findings.drop("seq", "sent_id", "doc_row")


@query(FOUND + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, col, rule, sent_id, seq)::INT AS place, line, col, rule, severity FROM found")
def findings_in_order(spark, sf_dir):
    w = Window.partitionBy(*lines.DOC).orderBy("line", "col", "rule", "sent_id", "seq")
    return checked(spark, sf_dir).findings.select("doc_id", F.row_number().over(w).alias("place"), "line", "col", "rule", "severity")


JSON = """
, listed AS (SELECT doc_id, list({'line': line, 'col': col, 'rule': rule, 'message': message, 'suggestion': suggestion, 'severity': severity, 'term': term} ORDER BY line, col, rule, sent_id, seq) AS f FROM found GROUP BY doc_id),
maps AS (SELECT doc_id, map_from_entries(list((rule, n) ORDER BY rule) FILTER (severity = 'violation')) AS hard, map_from_entries(list((rule, n) ORDER BY rule) FILTER (severity = 'advisory')) AS soft FROM by_rule GROUP BY doc_id)
SELECT s.doc_id, to_json({'findings': coalesce(f, []), 'stats': {'sentences': sentences, 'counted_words': counted_words, 'max_sentence_words': max_sentence_words, 'words': words, 'mean_sentence_words': mean_sentence_words, 'violations': violations, 'advisories': advisories, 'unapproved_words': unapproved_words, 'unapproved_rate': unapproved_rate,
  'violations_by_rule': coalesce(hard, MAP {}), 'advisories_by_rule': coalesce(soft, MAP {})}})::VARCHAR AS json
FROM stats s LEFT JOIN listed USING (doc_id) LEFT JOIN maps USING (doc_id)
"""


@query(STATS + JSON)
def findings_json(spark, sf_dir):
    return check.as_json(checked(spark, sf_dir, both=True)).drop("doc_row")


@query(STATS + oracle.report() + "SELECT doc_id, part::INT AS part, ord::INT AS ord, said FROM said")
def report_text(spark, sf_dir):
    got = checked(spark, sf_dir, both=True, count_unknown=True)
    return report.report_lines(got.findings, got.stats, unknown=got.unknown).drop("doc_row")


@query(STATS + f"SELECT count(*) AS documents, sum(sentences)::BIGINT AS sentences, sum(words)::BIGINT AS words, sum(violations)::BIGINT AS violations, {oracle.exact_round('sum(counted_words) / sum(sentences)', 1)} AS mean_sentence_words, max(max_sentence_words) AS max_sentence_words, sum(violations) / sum(words) AS violation_rate FROM stats")
def corpus_rate(spark, sf_dir):
    return check.corpus_rate(checked(spark, sf_dir).stats)


@query(FOUND + "SELECT max((severity = 'violation')::INT) = 1 AS failed FROM found")
def any_violation(spark, sf_dir):
    got = checked(spark, sf_dir).findings
    return got.agg((F.max((F.col("severity") == rules.VIOLATION).cast("int")) == 1).alias("failed"))


CASES = [(-1, ["6.6"], ["6.3"]), (-2, [], ["6.6", "8.1"]), (-7, ["7.2", "7.3", "9.9"], []), (-8, ["4.2", "3.4", "3.6"], ["1.14", "5.2"]), (-10, ["1.1"], ["1.1"])]
CASE_ROWS = ", ".join(f"({i}::BIGINT, {oracle.array(m)}, {oracle.array(n)})" for i, m, n in CASES)


@query(FOUND + f", cases(doc_id, must, must_not) AS (VALUES {CASE_ROWS}), seen AS (SELECT doc_id, list(DISTINCT rule) AS seen FROM found GROUP BY doc_id) SELECT doc_id, array_to_string(list_sort(list_filter(must, lambda r: NOT coalesce(list_contains(seen, r), false))), ' ') AS missing, array_to_string(list_sort(list_filter(must_not, lambda r: coalesce(list_contains(seen, r), false))), ' ') AS forbidden FROM cases LEFT JOIN seen USING (doc_id)")
def rule_cases(spark, sf_dir):
    cases = spark.createDataFrame(CASES, "doc_id long, must array<string>, must_not array<string>")
    got = check.rule_cases(checked(spark, sf_dir, of=cases).findings, cases)
    return got.select("doc_id", F.array_join("missing", " ").alias("missing"), F.array_join("forbidden", " ").alias("forbidden"))


@query(WORDS + "SELECT CASE rung WHEN 'british' THEN '1.14' WHEN 'pos' THEN '1.2' WHEN 'bad' THEN '1.1' ELSE '1.6' END AS rule, count(*) AS n FROM rungs WHERE rung IS NOT NULL GROUP BY 1")
def findings_by_rule(spark, sf_dir):
    return word_verdicts(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(WORDS + "SELECT doc_id, rung, key AS what, count(*) AS n, min(line) AS first_line FROM rungs WHERE rung IN ('pos', 'term') GROUP BY ALL")
def advisory_groups(spark, sf_dir):
    f = word_verdicts(spark, sf_dir).where(F.col("message").contains("is a listed term") | (F.col("rule") == "1.2"))
    kind = F.when(F.col("rule") == "1.2", "pos").otherwise("term").alias("rung")
    return report.advisory_groups(f).select("doc_id", kind, "what", "n", "first_line")


@query(WORDS + ", u AS (SELECT doc_id, key, count(*) AS n, arg_min(word, row(line, col)) AS word FROM rungs WHERE rung = 'unknown' GROUP BY doc_id, key), m AS (SELECT doc_id, n > 1 OR contains(word, '-') OR regexp_matches(substr(word, 2), '[A-Z]') AS likely, CASE WHEN n > 1 THEN word || ' (' || n || 'x)' ELSE word END AS label FROM u) SELECT doc_id, likely, count(*) AS n_words, string_agg(label, ', ' ORDER BY lower(label), label) AS words FROM m GROUP BY ALL")
def unknown_word_buckets(spark, sf_dir):
    return report.unknown_buckets(report.advisory_groups(word_verdicts(spark, sf_dir))).drop("doc_row")


@query(WORDS + "SELECT key AS word, count(*) AS n FROM rungs WHERE rung = 'unknown' GROUP BY key ORDER BY n DESC, word LIMIT 50")
def top_unknown_words(spark, sf_dir):
    f = word_verdicts(spark, sf_dir).where(report.is_unknown())
    return f.groupBy(F.col("term").alias("word")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(WORDS + ", n AS (SELECT doc_id, count(*) AS words FROM toks GROUP BY doc_id) SELECT n.doc_id, n.words, count(r.rung) FILTER (r.rung = 'bad') AS unapproved FROM n LEFT JOIN rungs r USING (doc_id) GROUP BY ALL")
def violation_rate(spark, sf_dir):
    toks = plain_tokens(spark, sf_dir)
    bad = check.apart(rules.word_findings(toks, lexicon(spark)).where("rule = '1.1'").select(*lines.DOC, F.lit(0).alias("words"), F.lit(1).alias("unapproved")))
    both = check.apart(toks.select(*lines.DOC, F.lit(1).alias("words"), F.lit(0).alias("unapproved"))).unionByName(bad)
    return both.groupBy(*lines.DOC).agg(F.sum("words").alias("words"), F.sum("unapproved").alias("unapproved")).drop("doc_row")


@query("SELECT CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS INT) AS quality, count(*) AS docs, sum(len(d.text))::BIGINT AS chars FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1")
def chars_by_quality(spark, sf_dir):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(lab, "doc_id")
    return d.groupBy((F.col("quality") == 1).cast("int").alias("quality")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


# --- sections, groups, ranks and sketches ------------------------------------------------------------


def headings(docs):
    """(doc_row, line, section): the lines that a heading mark begins, outside code."""
    lined = lines.fenced(docs).where(~F.col("fence") & ~F.col("in_fence") & F.col("raw").rlike(r"(?U)^\s*#{1,6}\s+"))
    return lined.select("doc_row", F.col("line_no").alias("line"), strip(F.regexp_replace("raw", r"(?U)^\s*#{1,6}\s+", "")).alias("section"), F.col("line_no").alias("section_line"))


HEADINGS = r", heads AS (SELECT doc_id, line_no AS line, regexp_replace(regexp_replace(raw, '^\s*#{1,6}\s+', ''), '^\s+|\s+$', '', 'g') AS section FROM fences WHERE NOT fence AND NOT inside AND regexp_matches(raw, '^\s*#{1,6}\s+'))"
LONG = f"SELECT doc_id, line, col, n_words FROM counted WHERE n_words > {C.WORDS_DESCRIPTIVE}"


def long_in_sections(docs):
    """Sentences beyond the limit, each with the last heading at or before its line; a document is cut at every 256 lines."""
    long = sentences(docs).withColumn("n_words", controlled_words(F.col("text"))).where(F.col("n_words") > C.WORDS_DESCRIPTIVE).select(*lines.DOC, "line", "col", "n_words")
    return as_of(long, headings(docs), ["doc_row"], "line", ["section", "section_line"], F.floor(F.col("line") / 256)).select("doc_id", "line", "col", "n_words", "section", "section_line")


SECTIONS = HEADINGS + f" SELECT f.doc_id, f.line, f.col, f.n_words::INT AS n_words, h.section, h.line::INT AS section_line FROM ({LONG}) f ASOF LEFT JOIN heads h ON f.doc_id = h.doc_id AND f.line >= h.line"


@query(BASE + SECTIONS)
def findings_by_section(spark, sf_dir):
    return long_in_sections(lines.numbered(documents(spark, sf_dir)))


PAGE = "html"
for pattern, new in html.STEPS:
    PAGE = f"regexp_replace({PAGE}, {oracle.text(pattern)}, {oracle.text(new)}, 'g')"
PAGE = f"array_to_string(list_transform(string_split(regexp_replace({PAGE}, '&#(\\d{{1,7}});', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p, i: CASE WHEN i = 1 THEN p WHEN split_part(p, chr(2), 1)::INT BETWEEN 32 AND 55295 OR split_part(p, chr(2), 1)::INT BETWEEN 57344 AND 1114111 THEN chr(split_part(p, chr(2), 1)::INT) || substr(p, instr(p, chr(2)) + 1) ELSE ' ' || substr(p, instr(p, chr(2)) + 1) END), '')"
for name, char in html.ENTITIES:
    PAGE = f"replace({PAGE}, '&{name};', {oracle.text(char)})"
PAGES = oracle.base(f"SELECT page_id AS doc_id, {PAGE} AS text FROM pages")


def pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return lines.numbered(rows.select(F.col("page_id").alias("doc_id"), html.prose(F.col("html")).alias("text")))


@query(PAGES + "SELECT doc_id AS page_id, sent_id, line, col, text, paragraph FROM sents")
def page_sentences(spark, sf_dir):
    return sentences(pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id").drop("doc_row")


@query(PAGES + SECTIONS)
def page_findings_by_section(spark, sf_dir):
    return long_in_sections(pages(spark, sf_dir))


EVENT_BY = "SELECT e.event_id, e.user_id, e.value, p.event_id AS purchase_id, p.value AS purchase_value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"


@query(EVENT_BY)
def last_purchase(spark, sf_dir):
    """Each event with its user's last purchase; a user is cut at every day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return as_of(e.select("event_id", "user_id", "ts", "value"), bought, ["user_id"], "ts", ["purchase_id", "purchase_value"], F.to_date("ts")).drop("ts")


def corpus(spark, sf_dir):
    """(doc_row, doc_id, text, lang, source): the documents, with the columns that groups are made of."""
    return lines.numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def grouped_sentences(spark, sf_dir):
    """Sentences with lang and source, which go along as part of the name of a document, so that nothing is joined."""
    d = corpus(spark, sf_dir).withColumn("doc_id", F.struct("doc_id", "lang", "source"))
    return sentences(d).select("doc_id.*", "sent_id", "text")


BROKEN = "CASE WHEN n_words > {limit} THEN '6.3' WHEN regexp_matches(text, '[!?]$') THEN 'mark' ELSE 'none' END"


@query(oracle.base() + f", s AS (SELECT lang, source, {BROKEN.format(limit=C.WORDS_DESCRIPTIVE)} AS kind, n_words FROM counted JOIN (SELECT doc_id, lang, source FROM documents) d USING (doc_id)) SELECT lang, source, kind, grouping(lang, source, kind)::BIGINT AS level, count(*) AS sentences, quantile_cont(n_words, 0.5) AS p50, quantile_cont(n_words, 0.9) AS p90, quantile_cont(n_words, 0.99) AS p99, max(n_words)::INT AS longest FROM s GROUP BY CUBE (lang, source, kind)")
def length_percentiles(spark, sf_dir):
    """Sentence lengths in every combination of language, source and kind; counts of equal lengths are added up before rows are made for each combination."""
    s = grouped_sentences(spark, sf_dir).withColumn("n_words", controlled_words(F.col("text")))
    kind = F.when(F.col("n_words") > C.WORDS_DESCRIPTIVE, "6.3").when(F.col("text").rlike("[!?]$"), "mark").otherwise("none")
    counted = s.groupBy("lang", "source", kind.alias("kind"), "n_words").agg(F.count(F.lit(1)).alias("n"))
    out = counted.cube("lang", "source", "kind").agg(F.grouping_id().alias("level"), F.sum("n").alias("sentences"), *(F.expr(f"percentile(n_words, {p}, n)").alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)), F.max("n_words").alias("longest"))
    return out.select("lang", "source", "kind", "level", "sentences", "p50", "p90", "p99", "longest")


@query(WORDS + ", n AS (SELECT doc_id, count(*) AS words FROM toks GROUP BY doc_id), r AS (SELECT n.doc_id, count(r.rung) FILTER (r.rung = 'bad') / n.words AS rate FROM n LEFT JOIN rungs r USING (doc_id) GROUP BY n.doc_id, n.words) SELECT doc_id, rate, rank() OVER (ORDER BY rate) AS rank, percent_rank() OVER (ORDER BY rate) AS percent_rank, ntile(100) OVER (ORDER BY rate, doc_id)::INT AS tile FROM r")
def violation_ranks(spark, sf_dir):
    rates = QUERIES["violation_rate"](spark, sf_dir).select("doc_id", (F.col("unapproved") / F.col("words")).alias("rate"))
    return ranked(rates, "rate", ["doc_id"])


WORD_GROUPS = oracle.base() + ", w AS (SELECT d.lang, d.source, lower(word) AS word FROM toks JOIN (SELECT doc_id, lang, source FROM documents) d USING (doc_id))"


@query(WORD_GROUPS + " SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n_words, count(DISTINCT word) AS exact, true AS within FROM w GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def distinct_word_sketches(spark, sf_dir):
    """Distinct words by sketches made once for each source and merged for languages and the whole, beside exact counts; within: whether the estimate keeps its bound."""
    each = sketches.words(grouped_sentences(spark, sf_dir), "lang", "source")
    small = sketches.word_sketches(each, "lang", "source")
    levels = [(0, small), (1, sketches.merged(small, "lang").withColumn("source", F.lit(None).cast("string"))), (3, sketches.merged(small).withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}))]
    made = reduce(DataFrame.unionByName, (sketches.estimates(df).select("lang", "source", F.lit(k).cast("long").alias("level"), "n_words", "distinct") for k, df in levels))
    kinds = each.groupBy("lang", "source", "word").agg(F.lit(1).alias("one"))
    exact = kinds.cube("lang", "source").agg(F.grouping_id().alias("level"), F.countDistinct("word").alias("exact")).where("level <> 2")
    e = exact.select(*(F.col(c).alias(f"__{c}") for c in ("lang", "source", "level")), "exact")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("lang", "source", "level")))
    return made.join(e, same).select("lang", "source", "level", "n_words", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= sketches.BOUND * F.col("exact") + 1).alias("within"))


@query(WORD_GROUPS + ", n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM n) SELECT lang, word, n AS exact, true AS within FROM r WHERE place <= 5")
def frequent_word_sketches(spark, sf_dir):
    """The five most frequent words of each language, with whether the merged sketch has each of them and a count within its bound."""
    each = sketches.words(grouped_sentences(spark, sf_dir), "lang", "source")
    made = sketches.estimates(sketches.merged(sketches.word_sketches(each, "lang", "source"), "lang"), 50).select(F.col("lang").alias("__lang"), "top_bound", F.explode("top").alias("t"))
    made = made.select("__lang", "top_bound", F.col("t.item").alias("__word"), F.col("t.count").alias("estimate"))
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("exact"))
    first = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("exact"), "word"))).where("place <= 5")
    got = first.join(made, (F.col("lang") == F.col("__lang")) & (F.col("word") == F.col("__word")), "left")
    return got.select("lang", "word", "exact", F.coalesce((F.col("estimate") >= F.col("exact") - F.col("top_bound")) & (F.col("estimate") <= F.col("exact") + F.col("top_bound")), F.lit(False)).alias("within"))


#: Named before the steps of the check, one of which is called labels too.
JUDGED = STATS.replace("WITH ", "WITH judged AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), ", 1)


@query(JUDGED + f"SELECT l.quality, count(*) AS documents, sum(sentences)::BIGINT AS sentences, sum(words)::BIGINT AS words, sum(violations)::BIGINT AS violations, {oracle.exact_round('sum(counted_words) / sum(sentences)', 1)} AS mean_sentence_words, max(max_sentence_words) AS max_sentence_words, sum(violations) / sum(words) AS violation_rate FROM stats JOIN judged l USING (doc_id) GROUP BY l.quality")
def rates_by_quality(spark, sf_dir):
    """How far good and bad documents, as labelled, are apart in what the rules count."""
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return check.corpus_rate(checked(spark, sf_dir, of=judged, violations_only=True).stats.join(judged, "doc_id"), "quality")


@query(WORDS + "SELECT r.key AS term, len(x.good) = 0 AS hard, array_to_string(list_sort(list_distinct(x.bad)), '/') AS disapproved_as, count(*) AS n, count(DISTINCT doc_id) AS docs FROM rungs r JOIN lex x ON x.key = r.key WHERE x.domain AND x.unapproved GROUP BY ALL")
def term_audit_of_documents(spark, sf_dir):
    """Listed terms that are disallowed words, with how often the documents hold them."""
    words = plain_tokens(spark, sf_dir).select("doc_row", trim_edge(F.lower("word")).alias("term")).where("length(term) > 1")
    held = words.groupBy("term", "doc_row").agg(F.count(F.lit(1)).alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))
    audit = report.audit(fixtures.entries(spark, fixtures.FULL), listed_terms(spark)).select("term", "hard", "disapproved_as")
    return audit.join(held, "term")


# --- streams and changes ------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS cut FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS last_until, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def streamed_sessions(spark, sf_dir):
    """The events as a stream in four parts of time, each in a run of its own that goes on with the state of the one before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    at = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    ends = e.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - ends.a) * 4 / max(ends.b - ends.a, 1.0)), F.lit(3))
    for k in range(4):
        e.where(F.coalesce(part, F.lit(0)) == k).write.mode("append").parquet(f"{at}/in")
        write_sessions(spark.readStream.schema(e.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last_until")})


#: The dictionary before a change: without two entries.
BEFORE = [e for e in fixtures.FULL if e[0].lower() not in ("thatin", "clamp")]
OLD_FOUND = BASE + oracle.lexicon(BEFORE, fixtures.TERMS) + oracle.findings(BEFORE, fixtures.TERMS)
SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("doc_id", "line", "col", "rule", "message", "suggestion", "severity", "term"))
COUNTED = "SELECT doc_id, line, col, rule, message, suggestion, severity, term, count(*) AS k FROM found GROUP BY ALL"


@lru_cache(maxsize=2)
def lexicon_before(spark: SparkSession) -> Lexicon:
    return fixtures.lexicon(spark, BEFORE, fixtures.TERMS)


def rechecked(spark, sf_dir):
    docs = lines.numbered(documents(spark, sf_dir))
    old = written(check.check_text(docs, lexicon_before(spark)).findings)
    return old, recheck.recheck(docs, recheck.word_index(docs), old, lexicon_before(spark), lexicon(spark))


@query(FOUND + "SELECT doc_id, line, col, rule, message, suggestion, severity, term FROM found")
def recheck_findings(spark, sf_dir):
    """Findings after a change of the dictionary, of which those of documents without a changed word are the old ones."""
    return rechecked(spark, sf_dir)[1].drop("seq", "sent_id", "doc_row")


@query(f"SELECT coalesce(a.rule, b.rule) AS rule, sum(greatest(coalesce(a.k, 0) - coalesce(b.k, 0), 0))::BIGINT AS removed, sum(greatest(coalesce(b.k, 0) - coalesce(a.k, 0), 0))::BIGINT AS added, sum(least(coalesce(a.k, 0), coalesce(b.k, 0)))::BIGINT AS kept FROM ({OLD_FOUND + COUNTED}) a FULL JOIN ({FOUND + COUNTED}) b ON {SAME} GROUP BY 1")
def recheck_changes(spark, sf_dir):
    return recheck.changes_by_rule(documents(spark, sf_dir), lexicon_before(spark), lexicon(spark))


# --- terms and dictionaries --------------------------------------------------------------------------

TERM_LINES = ["wire harness # a part", "# a line of notes", "", "PASS", "permit", "PASS  # again", "  Prior to "]
TERM_VALUES = "SELECT * FROM (VALUES " + ", ".join(f"({oracle.text(x)})" for x in TERM_LINES) + ") AS l(value)"


LINES_SQL = "SELECT unnest(string_split(text, chr(10))) FROM documents"


def text_lines(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias(name))


def listed_terms(spark):
    return spark.createDataFrame([(t,) for t in fixtures.TERMS], "term string")


def all_terms(spark, sf_dir) -> DataFrame:
    """The listed terms and the words of the benchmark."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))
    return listed_terms(spark).unionByName(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words.alias("w")).select(F.lower("w").alias("term"))).distinct()


def all_entries(spark, sf_dir) -> DataFrame:
    """The invented entries and, behind them, those drafted from the documents."""
    drafted = draft_entries(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.xxhash64("doc_id", "text").alias("doc_row"))))
    return fixtures.entries(spark, fixtures.FULL).unionByName(drafted.withColumn("seq", (F.col("seq") + len(fixtures.FULL) - 1).cast("int")))


BENCHMARK_WORDS = "SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{4,}'))) FROM benchmark"
ALL_TERMS = f"SELECT unnest({oracle.array(fixtures.TERMS)}) AS term UNION {BENCHMARK_WORDS}"
DRAFT = f"""WITH w AS (SELECT word, count(*) AS docs FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x)))) AS word FROM documents) GROUP BY word HAVING count(*) >= 2 AND count(*) * {ONE_IN} >= (SELECT count(*) FROM documents)),
g AS (SELECT list(word ORDER BY docs DESC, word) AS ws, max(docs) AS docs, CASE WHEN bool_or(regexp_matches(word, '^[a-z]{{3,}}(ing|ed)$')) THEN 'v' ELSE 'n' END AS pos FROM w GROUP BY regexp_replace(word, '{ENDING}', '\\1\\3')),
h AS (SELECT ws[1] AS head, list_transform(list_sort(ws[2:]), lambda x: upper(x)) AS forms, pos, docs, (SELECT count(*) FROM documents) AS n, docs * {APPROVED_ONE_IN} >= (SELECT count(*) FROM documents) AS approved FROM g),
a AS (SELECT head[1:3] AS start, pos, first(upper(head) ORDER BY docs DESC, head) AS word FROM h WHERE approved GROUP BY ALL)
SELECT {len(fixtures.FULL) - 1} + row_number() OVER (ORDER BY head), CASE WHEN approved THEN upper(head) ELSE head END, h.pos, approved, forms, docs || ' of ' || n || ' documents', CASE WHEN approved OR a.word IS NULL THEN [] ELSE [a.word] END, CASE WHEN approved OR a.word IS NULL THEN [] ELSE [h.pos] END FROM h LEFT JOIN a ON a.start = h.head[1:3] AND a.pos = h.pos"""
ALL_ENTRIES = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {oracle.text(h)}, {oracle.text(p)}, {str(ok).lower()}, {oracle.array(f)}, {oracle.text(note)}, {oracle.array(w for w, *_ in alts)}, {oracle.array(q for _, q, *_ in alts)})" for k, (h, p, ok, f, note, _, alts, _, _) in enumerate(fixtures.FULL)) + f") AS e(seq, head, pos, approved, forms, note, words, parts) UNION ALL ({DRAFT})"


@query(f"SELECT seq::INT AS seq, head, pos, approved, array_to_string(forms, ' ') AS forms, note, array_to_string(words, ' ') AS alternatives FROM ({ALL_ENTRIES})")
def dictionary_draft(spark, sf_dir):
    """Entries drafted from the documents, behind the invented ones."""
    return all_entries(spark, sf_dir).select("seq", F.col("headword").alias("head"), "pos", "approved", F.array_join("forms", " ").alias("forms"), "note", F.array_join(F.transform("alternatives", lambda a: a["word"]), " ").alias("alternatives"))


@query(f"SELECT DISTINCT trim(string_split(value, '#')[1]) AS term FROM ({TERM_VALUES} UNION ALL {LINES_SQL}) WHERE trim(string_split(value, '#')[1]) <> ''")
def term_list(spark, sf_dir):
    """A list of terms and, read as one more, the lines of the documents."""
    return parse_terms(spark.createDataFrame([(x,) for x in TERM_LINES], "value string").unionByName(text_lines(spark, sf_dir, "value")))


@query(f"SELECT unnest({oracle.array(dict.fromkeys([*DEFAULT_TERMS, 'permit', 'Spark', 'lid']))}) AS term UNION {BENCHMARK_WORDS} UNION SELECT unnest({oracle.array(fixtures.TERMS)})")
def default_terms(spark, sf_dir):
    return with_default_terms(spark.createDataFrame([("permit",), ("Spark",), ("lid",)], "term string").unionByName(all_terms(spark, sf_dir)), spark)


AUDIT = f"""WITH e AS ({ALL_ENTRIES}), t AS ({ALL_TERMS}),
good AS (SELECT lower(w) AS key, list_sort(list_distinct(list(pos))) AS pos FROM (SELECT pos, unnest(regexp_extract_all(f, '[A-Za-z][A-Za-z''-]*')) AS w FROM (SELECT pos, unnest(list_concat([head], forms)) AS f FROM e WHERE approved)) GROUP BY 1),
bad AS (SELECT lower(head) AS key, list_sort(list_distinct(list(pos))) AS pos, list_sort(list_distinct(flatten(list(words)))) AS alts FROM e WHERE NOT approved GROUP BY 1),
roles AS (SELECT b.key AS term, g.key IS NULL AS hard, array_to_string(b.pos, '/') AS disapproved_as, coalesce(array_to_string(g.pos, '/'), '') AS approved_as, array_to_string(alts, ', ') AS alternatives FROM bad b LEFT JOIN good g USING (key) WHERE b.key IN (SELECT term FROM t WHERE term = lower(term))),
listed AS (SELECT count(DISTINCT lower(term)) AS n, count(*) FILTER (term <> lower(term)) AS cased FROM t) """


@query(AUDIT + "SELECT * FROM roles")
def audit_collisions(spark, sf_dir):
    return report.audit(all_entries(spark, sf_dir), all_terms(spark, sf_dir))


@query(AUDIT + ", n AS (SELECT count(*) AS c FROM roles) SELECT part, ord, said FROM (SELECT 0 AS part, 0 AS ord, listed.n || ' terms (' || cased || ' matched as written); ' || c || ' of them are disallowed words' AS said FROM n, listed UNION ALL SELECT CASE WHEN hard THEN 1 ELSE 2 END, (row_number() OVER (PARTITION BY hard ORDER BY term) - 1)::INT, term || ': ' || CASE WHEN hard THEN 'not approved as ' || disapproved_as || ' -> ' || alternatives ELSE 'approved as ' || approved_as || ', not as ' || disapproved_as END FROM roles)")
def audit_text(spark, sf_dir):
    return report.audit_lines(all_entries(spark, sf_dir), all_terms(spark, sf_dir))


@query(AUDIT + ", both_ AS (SELECT list({'term': term, 'disapproved_as': disapproved_as, 'approved_as': approved_as, 'alternatives': alternatives} ORDER BY term) FILTER (hard) AS h, list({'term': term, 'disapproved_as': disapproved_as, 'approved_as': approved_as, 'alternatives': alternatives} ORDER BY term) FILTER (NOT hard) AS s FROM roles) SELECT to_json({'hard': coalesce(h, []), 'soft': coalesce(s, []), 'terms': (SELECT n FROM listed)})::VARCHAR AS json FROM both_")
def audit_json(spark, sf_dir):
    return report.audit_json(all_entries(spark, sf_dir), all_terms(spark, sf_dir))


@query(AUDIT + "SELECT n AS all_terms, cased AS cased_terms, (SELECT count(*) FROM roles)::INT AS collisions FROM listed")
def term_counts(spark, sf_dir):
    return report.term_counts(all_entries(spark, sf_dir), all_terms(spark, sf_dir)).withColumn("collisions", F.col("collisions").cast("int"))


@query(f"WITH e AS ({ALL_ENTRIES}), s AS (SELECT pos, unnest(list_concat([head], forms)) AS f FROM e WHERE approved), t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(f, '[A-Za-z][A-Za-z''-]*'))) AS surface, pos FROM s) SELECT surface, string_agg(pos, '/' ORDER BY pos) AS pos FROM t GROUP BY surface")
def approved_form_index(spark, sf_dir):
    return approved_forms(all_entries(spark, sf_dir)).select("surface", F.array_join("pos", "/").alias("pos"))


@query(f"SELECT seq::INT AS seq, '## ' || head || ' (' || pos || ') - ' || CASE WHEN approved THEN 'APPROVED' ELSE 'NOT APPROVED' END || CASE WHEN len(forms) > 0 THEN chr(10) || 'Forms: ' || array_to_string(forms, ', ') ELSE '' END || array_to_string(list_transform(range(1, len(words) + 1), lambda i: chr(10) || 'Use instead: ' || words[i] || ' (' || parts[i] || ')'), '') || chr(10) AS block FROM ({ALL_ENTRIES})")
def dictionary_markdown(spark, sf_dir):
    return dictionary.as_markdown(all_entries(spark, sf_dir))


@query(f"SELECT upper(head[1]) AS letter, count(*) AS n FROM ({ALL_ENTRIES}) GROUP BY 1")
def dictionary_letters(spark, sf_dir):
    return dictionary.letters(all_entries(spark, sf_dir))


@query(f"WITH e AS ({ALL_ENTRIES}), f AS (SELECT pos, unnest(list_concat([head], forms)) AS f FROM e WHERE approved), s AS (SELECT DISTINCT lower(unnest(regexp_extract_all(f, '[A-Za-z][A-Za-z''-]*'))) AS surface, pos FROM f), g AS (SELECT surface, list(pos ORDER BY pos) AS p FROM s GROUP BY surface) SELECT 'mine' AS source, (SELECT count(*) FROM e)::INT AS entry_count, (SELECT string_agg(surface || '=' || array_to_string(p, '/'), ' ' ORDER BY surface) FROM g) AS forms, (SELECT string_agg(head, ' | ' ORDER BY seq) FROM e) AS headwords")
def dictionary_file(spark, sf_dir):
    out = dictionary.as_dictionary(all_entries(spark, sf_dir), "mine")
    forms = F.transform(F.map_entries("approved_forms"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/")))
    return out.select("source", "entry_count", F.array_join(forms, " ").alias("forms"), F.array_join(F.transform("entries", lambda e: e["headword"]), " | ").alias("headwords"))


@query(f"""WITH e AS ({ALL_ENTRIES}),
keys AS (SELECT seq, regexp_replace(lower(head), '[^a-z0-9]', '', 'g') AS word, regexp_replace(lower(head), '[^a-z0-9 ]', '', 'g') AS spaced FROM e)
SELECT seq::INT AS seq, previous, word FROM (SELECT *, coalesce(lag(word) OVER (ORDER BY seq), '') AS previous, coalesce(lag(spaced) OVER (ORDER BY seq), '') AS before FROM keys) WHERE word < previous AND spaced < before""")
def alphabetical_regressions(spark, sf_dir):
    return dictionary.regressions(all_entries(spark, sf_dir))


# --- dictionary building from pages -------------------------------------------------------------------

CELLS = ["LIFT (v), LIFTS, LIFTED", "BE (v), IS, WAS, (also ARE, WERE) No other verb", "such as", "not a headword at all here", "lug (v)", "", "x (q)", "wash away (v)"]
HEAD = rf"^(.+?)\s*\(({dictionary.POS})\)\s*(.*)$"
REST = f"regexp_extract({{0}}, '{HEAD}', 3)"
NOTE = rf"trim(regexp_replace(regexp_replace(regexp_replace({REST}, '\b[A-Z][A-Z''-]+\b', ' ', 'g'), '[(),]', ' ', 'g'), '\s+', ' ', 'g'))"
NOTE = f"CASE WHEN starts_with(lower({NOTE}), 'also') THEN trim(substr({NOTE}, 5)) ELSE {NOTE} END"
HEAD_WORD = f"regexp_replace(trim(regexp_extract({{0}}, '{HEAD}', 1)), '^,+|,+$', '', 'g')"
TAGGED, PLAIN = f"regexp_matches({{0}}, '{HEAD}')", "regexp_matches({0}, '^[A-Za-z][A-Za-z''-]*(?: [A-Za-z''-]+){{0,3}}$')"
FORMS = rf"array_to_string(regexp_extract_all({REST}, '\b[A-Z][A-Z''-]+\b'), ' ')"


def head_sql(x: str) -> str:
    """Columns word, pos, forms, note of a headword cell, nulls where it is none."""
    each = {"word": (HEAD_WORD, "{0}"), "pos": (f"regexp_extract({{0}}, '{HEAD}', 2)", "NULL"), "forms": (FORMS, "''"), "note": (NOTE, "''")}
    return ", ".join(f"CASE WHEN {TAGGED.format(x)} THEN {a.format(x)} WHEN {PLAIN.format(x)} THEN {b.format(x)} END AS {n}" for n, (a, b) in each.items())


@query(f"SELECT cell, {head_sql('cell')} FROM (SELECT DISTINCT trim(cell) AS cell FROM (SELECT unnest({oracle.array(CELLS)}) AS cell UNION ALL {LINES_SQL}))")
def headword_parse(spark, sf_dir):
    """Invented cells and, read as cells, the different lines of the documents."""
    cells = spark.createDataFrame([(c,) for c in CELLS], "cell string").unionByName(text_lines(spark, sf_dir, "cell"))
    rows = cells.select(F.trim("cell").alias("cell")).distinct().withColumn("h", dictionary.split_headword(F.col("cell")))
    return rows.select("cell", "h.word", "h.pos", F.when(F.col("h").isNotNull(), F.array_join("h.forms", " ")).alias("forms"), "h.note")


def page_frames(spark):
    words = spark.createDataFrame([(p, x, y, x + 20.0, y + 8.0, w) for p, x, y, w in fixtures.PAGE_WORDS], "page int, x0 double, y0 double, x1 double, y1 double, word string")
    rules_ = [(p, float(a), float(b), float(y), 0.5, float(b - a)) for p in (1, 2, 3) for y in range(20, 160, 20) for a, b in ((10, 110), (110, 210), (210, 310), (310, 410))]
    drawings = spark.createDataFrame(rules_, "page int, x0 double, x1 double, y0 double, height double, width double")
    heads = spark.createDataFrame([(p, 5.0, 11.0, f"Page {p}") for p in (1, 2)], "page int, y0 double, y1 double, text string")
    return words, drawings, heads


def bands(spark):
    return dictionary.bands(*page_frames(spark))


WORD_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {x}, {y}, {oracle.text(w)})" for p, x, y, w in fixtures.PAGE_WORDS) + ") AS w(page, x, y, word)"
GRID = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {y}.0, {a}.0, {a + 100}.0)" for p in (1, 2, 3) for y in range(20, 160, 20) for a in (10, 110, 210, 310)) + ") AS g(page, y, x0, x1)"
BANDS = f"""WITH w AS ({WORD_ROWS}), g AS ({GRID}),
ys AS (SELECT DISTINCT page, y FROM g), ends AS (SELECT page, max(y) + 9 AS bottom FROM w GROUP BY page), edges AS (SELECT page, y AS top, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y), CASE WHEN bottom > y + 1 THEN bottom END) AS low, (row_number() OVER (PARTITION BY page ORDER BY y) - 1)::INT AS band FROM ys LEFT JOIN ends USING (page)),
xs AS (SELECT DISTINCT page, unnest([x0, x1]) AS x FROM g), cols AS (SELECT page, x, (row_number() OVER (PARTITION BY page ORDER BY x) - 1)::INT AS cell FROM xs),
placed AS (SELECT w.*, e.band, (SELECT least(max(c.cell), 3) FROM cols c WHERE c.page = w.page AND w.x > c.x - 2) AS cell FROM w JOIN edges e ON e.page = w.page AND w.y + 4 >= e.top AND w.y + 4 < e.low),
cells AS (SELECT page::INT AS page, band, cell, string_agg(word, ' ' ORDER BY x) AS text FROM placed GROUP BY ALL)
"""


@query(BANDS + "SELECT page, band, cell, text FROM cells")
def page_row_bands(spark, sf_dir):
    rows = bands(spark).select("page", "band", F.posexplode("cells").alias("cell", "text"))
    return rows.where("text <> ''")


@query(f"WITH g AS ({GRID}), n AS (SELECT page, x, count(*) AS n FROM (SELECT page, unnest([x0, x1]) AS x FROM g) GROUP BY ALL HAVING count(*) >= 5) SELECT DISTINCT (page % 2)::INT AS parity, x::DOUBLE AS col FROM n")
def column_bucket(spark, sf_dir):
    return dictionary.column_grid(page_frames(spark)[1]).select(F.col("parity").cast("int"), F.explode("cols").alias("col"))


ENTRIES = BANDS + f"""
, r AS (SELECT page, band, coalesce(max(text) FILTER (cell = 0), '') AS head, coalesce(max(text) FILTER (cell = 1), '') AS second, coalesce(max(text) FILTER (cell = 2), '') AS good, coalesce(max(text) FILTER (cell = 3), '') AS bad FROM cells GROUP BY page, band),
p AS (SELECT *, {head_sql('head')} FROM r WHERE NOT starts_with(head, 'Word') AND NOT starts_with(second, 'Approved meaning')),
a AS (SELECT *, CASE WHEN {TAGGED.format('second')} THEN {HEAD_WORD.format('second')} END AS a_word, CASE WHEN {TAGGED.format('second')} THEN regexp_extract(second, '{HEAD}', 2) END AS a_pos,
  head <> '' AND word IS NOT NULL AS named, second = '' AND good = '' AND bad = '' AS alone FROM p),
o AS (SELECT *, named AND (NOT alone OR sum(named::INT) OVER (ORDER BY page, band) = 1) AS opens FROM a),
e AS (SELECT *, sum(opens::INT) OVER (ORDER BY page, band) AS entry FROM o),
f AS (SELECT *, first_value(upper(word) = word AND lower(word) <> word) OVER (PARTITION BY entry ORDER BY page, band) AS approved FROM e WHERE entry > 0),
k AS (SELECT *, CASE WHEN NOT (opens OR head = '' OR NOT alone) THEN 'none' WHEN approved THEN 'meaning' WHEN second = '' THEN 'more' WHEN a_pos IS NOT NULL THEN 'tagged' WHEN upper(second) = second AND lower(second) <> second THEN 'plain' ELSE 'note' END AS kind,
  coalesce(nullif(trim(regexp_extract(a_word, '[A-Z][A-Z'' -]*$')), ''), a_word) AS tail FROM f),
n AS (SELECT *, sum((kind IN ('tagged', 'plain'))::INT) OVER (PARTITION BY entry ORDER BY page, band) AS option FROM k),
alt AS (SELECT entry, option, min(CASE kind WHEN 'tagged' THEN tail WHEN 'plain' THEN second END) AS w, min(CASE kind WHEN 'tagged' THEN a_pos END) AS p, trim(string_agg(good, ' ' ORDER BY page, band) FILTER (good <> '')) AS g, trim(string_agg(bad, ' ' ORDER BY page, band) FILTER (bad <> '')) AS b FROM n WHERE option > 0 AND kind IN ('tagged', 'plain', 'more') GROUP BY ALL),
alts AS (SELECT entry, list(w || '|' || coalesce(p, '') || '|' || coalesce(g, '') || '|' || coalesce(b, '') ORDER BY option) AS alts FROM alt GROUP BY entry),
one AS (SELECT entry, arg_min(CASE WHEN approved THEN word ELSE lower(word) END, row(page, band)) AS headword, arg_min(coalesce(pos, ''), row(page, band)) AS pos, any_value(approved) AS approved, arg_min(forms, row(page, band)) AS forms,
  trim(arg_min(note, row(page, band)) || ' ' || coalesce(string_agg(trim(CASE WHEN NOT opens THEN head ELSE '' END || ' ' || CASE kind WHEN 'note' THEN second WHEN 'tagged' THEN trim(substr(a_word, 1, len(a_word) - len(tail))) ELSE '' END), ' ' ORDER BY page, band) FILTER ((NOT opens AND head <> '') OR kind = 'note' OR (kind = 'tagged' AND tail <> a_word)), '')) AS note,
  coalesce(string_agg(second, ' ' ORDER BY page, band) FILTER (kind = 'meaning' AND second <> ''), '') AS definition,
  coalesce(string_agg(CASE WHEN good <> '' THEN good || CASE WHEN bad <> '' THEN ' / (not STE) ' || bad ELSE '' END ELSE '(not STE) ' || bad END, ' / ' ORDER BY page, band) FILTER (kind = 'meaning' AND (good <> '' OR bad <> '')), '') AS examples FROM n GROUP BY entry),
m AS (SELECT min(entry) - 1 AS seq, arg_min(headword, entry) AS headword, nullif(pos, '') AS pos, approved, trim(string_agg(forms, ' ' ORDER BY entry)) AS forms, trim(string_agg(note, ' ' ORDER BY entry) FILTER (note <> '')) AS note, nullif(trim(string_agg(definition, ' ' ORDER BY entry)), '') AS definition,
  array_to_string(flatten(list(coalesce(alts, []) ORDER BY entry)), '; ') AS alternatives, trim(string_agg(examples, ' ' ORDER BY entry)) AS examples FROM one LEFT JOIN alts USING (entry) GROUP BY lower(headword), pos, approved)
"""


def built(spark):
    return dictionary.merge_entries(dictionary.parse_entries(bands(spark)))


@query(ENTRIES + "SELECT seq::INT AS seq, headword, pos, approved, forms, coalesce(note, '') AS note, definition, alternatives, examples FROM m")
def dictionary_entries(spark, sf_dir):
    alt = F.array_join(F.transform("alternatives", lambda a: F.concat_ws("|", a["word"], F.coalesce(a["pos"], F.lit("")), a["ste_example"], a["non_ste_example"])), "; ")
    return built(spark).select("seq", "headword", "pos", "approved", F.array_join("forms", " ").alias("forms"), "note", "definition", alt.alias("alternatives"), F.array_join("examples", " / ").alias("examples"))


EXPECTED = [("lug", "v", False, ["PULL", "MEASURE", "FOR EXAMPLE"]), ("lift", "v", True, None), ("clean", "adj", False, None), ("gone", "n", True, None)]
SECTION_PAGES = [(1, "Page 1\nRule 1. Use short words.\n\n\n\nPage 1 of 9 is kept"), (2, "Rule 2.\nPage 2\nKeep “it” – so…"), (3, "Page 3\nGuide  text\n\n\nends")]
SECTIONS = [("one", "Rules", 1, 2), ("two", "Guide", 3, 3)]


@query(ENTRIES + f"""
, kk AS (SELECT seq, regexp_replace(lower(headword), '[^a-z0-9]', '', 'g') AS w, regexp_replace(lower(headword), '[^a-z0-9 ]', '', 'g') AS s FROM m),
reg AS (SELECT count(*) AS n FROM (SELECT *, lag(w) OVER (ORDER BY seq) AS pw, lag(s) OVER (ORDER BY seq) AS ps FROM kk) WHERE w < pw AND s < ps),
checks(name, n, bad) AS (
  SELECT 'alphabetical order', n, 'warn' FROM reg
  UNION ALL SELECT 'an alternative for each disallowed entry', count(*) FILTER (NOT approved AND alternatives = ''), 'warn' FROM m
  UNION ALL SELECT 'a meaning for each approved entry', count(*) FILTER (approved AND definition IS NULL), 'warn' FROM m
  UNION ALL SELECT 'a table on each page', 1, 'fail'
  UNION ALL SELECT 'a headword in each first cell', (SELECT count(*) FROM (SELECT *, sum(named::INT) OVER (ORDER BY page, band) AS before FROM a) WHERE head <> '' AND word IS NULL AND before = 0), 'fail'
),
spots(word, part, want, alts) AS (VALUES {', '.join(f"({oracle.text(w)}, {oracle.text(p)}, {str(ok).lower()}, {oracle.array(alts) if alts else 'NULL'})" for w, p, ok, alts in EXPECTED)}),
texts(page, t) AS (VALUES {', '.join(f'({p}, {oracle.text(x)})' for p, x in SECTION_PAGES)})
SELECT name, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS status, n::VARCHAR AS detail FROM checks
UNION ALL SELECT 'spot check: ' || word, CASE WHEN coalesce(approved = want AND (alts IS NULL OR list_transform(string_split(alternatives, '; '), lambda x: string_split(x, '|')[1]) = alts), false) THEN 'ok' ELSE 'fail' END, part FROM spots LEFT JOIN m ON lower(headword) = word AND pos = part
UNION ALL SELECT 'words of section ' || slug, CASE WHEN n >= 9 THEN 'ok' ELSE 'fail' END, n::VARCHAR FROM (VALUES ('one', 1, 2), ('two', 3, 3)) AS s(slug, lo, hi),
  LATERAL (SELECT sum(len(regexp_extract_all(array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_full_match(trim(l), 'Page [0-9]+')), ' '), '\\S+')))::BIGINT AS n FROM texts WHERE page BETWEEN lo AND hi)
""")
def dictionary_checks(spark, sf_dir):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "Blank Page")], "page int, text string")
    return dictionary.validate(built(spark), EXPECTED, dictionary.skipped_pages(pages, bands(spark)), dictionary.unparsed_headwords(bands(spark)), section_frame(spark), least_words=9)


def section_frame(spark):
    pages = spark.createDataFrame(SECTION_PAGES, "page int, text string")
    return dictionary.section_texts(pages, spark.createDataFrame(SECTIONS, "slug string, title string, first int, last int"), r"^Page \d+$")


SECTION_SQL = f"""WITH texts(page, t) AS (VALUES {', '.join(f'({p}, {oracle.text(x)})' for p, x in SECTION_PAGES)}), s(slug, title, lo, hi) AS (VALUES {', '.join(f'({oracle.text(a)}, {oracle.text(b)}, {c}, {d})' for a, b, c, d in SECTIONS)}),
kept AS (SELECT page, array_to_string(list_filter(string_split(replace(translate(t, {oracle.text(dictionary.FROM)}, {oracle.text(dictionary.TO)}), '…', '...'), chr(10)), lambda l: NOT regexp_full_match(trim(l), 'Page [0-9]+')), chr(10)) AS t FROM texts),
whole AS (SELECT slug, title, {oracle.strip("regexp_replace(string_agg(t, chr(10) ORDER BY page), '\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM s JOIN kept ON page BETWEEN lo AND hi GROUP BY slug, title)
SELECT slug, '# ' || title || chr(10) || chr(10) || body || chr(10) AS text, len(regexp_extract_all(body, '\\S+'))::INT AS n_words FROM whole"""


@query(SECTION_SQL)
def rule_sections(spark, sf_dir):
    return section_frame(spark)


@query(SECTION_SQL.replace("FROM whole", "FROM whole WHERE slug = 'two'").replace("SELECT slug, '# '", "SELECT 'dictionary-guide' AS slug, '# '").replace("|| chr(10) || chr(10) || body", "|| chr(10) || chr(10) || 'Pages 3 to 3.' || chr(10) || chr(10) || body"))
def dictionary_guide(spark, sf_dir):
    pages = spark.createDataFrame(SECTION_PAGES, "page int, text string")
    return dictionary.guide_text(pages, "Guide", 3, 3, r"^Page \d+$", lead="Pages 3 to 3.")


# --- separation gates ---------------------------------------------------------------------------------


@query(f"SELECT good, text FROM (VALUES {', '.join(f'({str(g).lower()}, {oracle.text(x)})' for g, x in fixtures.EXAMPLE_TEXTS)}) AS t(good, text)")
def example_sentences(spark, sf_dir):
    return selftest.sample(selftest.examples(fixtures.example_entries(spark)))


def gates_sql() -> str:
    one = lambda side: FOUND.replace(BASE, oracle.base("SELECT row_number() OVER ()::BIGINT AS doc_id, text FROM (VALUES " + ", ".join(f"({oracle.text(x)})" for g, x in fixtures.EXAMPLE_TEXTS if g == side) + ") AS v(text)"), 1)
    row = lambda side: f"SELECT {str(side).lower()} AS good, * FROM ({one(side)} SELECT (SELECT count(*) FROM found WHERE severity = 'violation')::BIGINT AS violations, (SELECT count(*) FROM toks)::BIGINT AS words, (SELECT max(n_words) FROM counted)::BIGINT AS max_sentence_words)"
    return f"{row(True)} UNION ALL {row(False)}"


@query(gates_sql())
def separation_rates(spark, sf_dir):
    lex = lexicon(spark)
    return selftest.rates(selftest.sample(selftest.examples(fixtures.example_entries(spark))), lex).select("good", "violations", "words", "max_sentence_words")


@query(f"WITH r AS ({gates_sql()}), x AS (SELECT max(violations / words) FILTER (good) AS g, max(violations / words) FILTER (NOT good) AS b, max(max_sentence_words) FILTER (good) AS m FROM r) SELECT unnest(['at most 1.5% of words in good text', 'at least 3% of words in bad text', 'bad text over 2 times good text', 'good sentences of at most 25 words']) AS name, unnest([CASE WHEN g <= 0.015 THEN 'ok' ELSE 'fail' END, CASE WHEN b >= 0.03 THEN 'ok' ELSE 'fail' END, CASE WHEN b > 2 * g THEN 'ok' ELSE 'fail' END, CASE WHEN m <= 25 THEN 'ok' ELSE 'fail' END]) AS status FROM x")
def separation_gates(spark, sf_dir):
    return selftest.gates(selftest.rates(selftest.sample(selftest.examples(fixtures.example_entries(spark))), lexicon(spark)))
