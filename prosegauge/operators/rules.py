"""Rules over sentences, tokens, paragraphs and lines. Each gives findings.

A finding is doc_row, doc_id, line, col, rule, message, suggestion, severity, term,
and sent_id with seq, which put findings of one place in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import constants as C
from prosegauge.functions.text import controlled_words, match_all, once, strip, tokens_of, unquoted
from prosegauge.operators.lines import DOC
from prosegauge.operators import words as W
from prosegauge.operators.words import with_words
from prosegauge.sources.lexicon import Lexicon

# The wording of messages and suggestions below is a fixed value of the output format.
COLUMNS = [*DOC, "line", "col", "rule", "message", "suggestion", "severity", "term", "sent_id", "seq"]
UNKNOWN, KEEP = "not in the dictionary", "keep a technical noun of the field and list it as a term"
VIOLATION, ADVISORY = "violation", "advisory"


def finding(df: DataFrame, rule, message: Column, suggestion=None, severity=VIOLATION, term=None, col: Column | None = None, seq: int = 0) -> DataFrame:
    """The findings of df's rows; times, how often a row of tallies stands for one, is kept."""
    as_col = lambda x, default="": F.lit(default) if x is None else F.lit(x) if isinstance(x, str) else x
    sent = F.col("sent_id") if "sent_id" in df.columns else F.lit(1 << 30)
    return df.select(*DOC, F.col("line").cast("int"), (F.col("col") if col is None else col).cast("int").alias("col"), as_col(rule).alias("rule"), message.alias("message"), as_col(suggestion).alias("suggestion"), as_col(severity).alias("severity"), as_col(term).alias("term"), sent.cast("int").alias("sent_id"), F.lit(seq).alias("seq"), *(["times"] if "times" in df.columns else []))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def first_of(labels: str, n: int) -> Column:
    return F.array_join(F.slice(labels, 1, n), ", ")


# --- columns of sentences and tokens ----------------------------------------------


def deciding_word(text: Column) -> Column:
    """The word that says whether a text is a command: its first one, after the commas of the conditions that come first."""
    tails = F.split(text, ",")
    n = F.size(tails)
    first = lambda c: F.lower(F.regexp_extract(unquoted(c), f"({C.TOKEN})", 1))
    firsts = F.transform(F.sequence(F.lit(1), n), lambda i: first(F.array_join(F.slice(tails, i, n), ",")))
    # the first tail whose first word is no condition decides; most texts decide at once
    start = first(text)
    return F.when(start.isin(*C.CONDITIONS), F.try_element_at(F.filter(firsts, lambda w: ~w.isin(*C.CONDITIONS)), F.lit(1))).otherwise(start)


def with_command(df: DataFrame, word: Column, lex: Lexicon, name: str) -> DataFrame:
    """df with a column that says whether a text with this deciding word starts with a command: the word is looked up in the broadcast lexicon."""
    own = lex.look_up(once(df, __word=word), F.col("__word"), "good_pos", prefix="__")
    verb = F.array_contains("__good_pos", "v") & ~F.col("__word").isin(*C.FUNCTION_WORDS)
    return own.withColumn(name, F.coalesce(F.col("__word").isin(*C.COMMANDS) | F.coalesce(verb, F.lit(False)), F.lit(False))).drop("__word", "__good_pos", "__listed")


def with_shape(sents: DataFrame, lex: Lexicon, mode: str = "auto") -> DataFrame:
    """Add n_words and procedural. Sentences with their words take both from these, where no number, parenthesis or quotation stands."""
    n_words, word = controlled_words(F.col("text")), deciding_word(F.col("text"))
    if "hints" in sents.columns:
        plain = ~may(W.COUNTED)
        n_words = F.when(plain, F.col("n_toks")).otherwise(n_words)
        word = F.when(plain & ~F.col("first").isin(*C.CONDITIONS), F.col("first")).otherwise(word)
    own = once(sents, n_words=n_words)
    return own.withColumn("procedural", F.lit(mode == "procedural")) if mode != "auto" else with_command(own, word, lex, "procedural")


def may(hint: int) -> Column:
    """Whether a sentence may hold what a hint of ``words`` says."""
    return F.col("hints").bitwiseAND(F.lit(hint)) > 0


def where_may(sents: DataFrame, hint: int) -> DataFrame:
    """The sentences that a pattern has to be tried on: all, where nothing is known of their words."""
    return sents.where(may(hint)) if "hints" in sents.columns else sents


def asks_for_text() -> Column:
    """Whether a rule of verbs or of shape looks at the text of a sentence with its words, beyond what is known of it."""
    return may(W.ALL_HINTS & ~W.ING & ~W.COUNTED) | F.col("procedural") | F.col("text").contains(";")


def with_tokens(sents: DataFrame) -> DataFrame:
    """Add toks alone, for what asks for words only."""
    return once(sents, toks=tokens_of(F.col("text")))


def phrase_spans(sents: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_row, doc_id, sent_id, line, col, start, end, phrase, kind): the phrases found. Terms all count; of disallowed phrases, longer ones take the text first.

    They are found inside the sentence, by the first word of a phrase, so
    neither plan nor work grows with the number of phrases, but for those that
    begin alike.
    """
    own = sents if "spans" in sents.columns else with_words(sents, lex)
    return own.select(*DOC, "sent_id", "line", "col", F.explode("spans").alias("s")).select(*DOC, "sent_id", "line", "col", "s.*")


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_row, doc_id, sent_id, line, col, idx, word, offset, prev_word, broken): one row for each token.

    broken: a punctuation mark stands before it. All is made inside the
    sentence, so that a token's row holds nothing else.
    """
    prev = lambda i: F.get("toks", i - 1)
    end = lambda i: F.coalesce(prev(i)["start"] + F.length(prev(i)["text"]), F.lit(0))
    marks = F.col("text").rlike(r'[,;:.()"]')
    broken = lambda t, i: (t["start"] > 0) & F.col("__marks") & F.substring("text", end(i) + 1, t["start"] - end(i)).rlike(r'[,;:.()"]')
    each = F.transform("toks", lambda t, i: F.struct(i.alias("idx"), t["text"].alias("word"), t["start"].alias("offset"), prev(i)["text"].alias("prev_word"), broken(t, i).alias("broken")))
    rows = once(sents, __marks=marks)
    return once(rows, each=each).select(*DOC, "sent_id", "line", "col", F.explode("each").alias("t")).select(*DOC, "sent_id", "line", "col", "t.*")


# --- vocabulary ----------------------------------------------------------------------


def phrase_findings(spans: DataFrame, lex: Lexicon) -> DataFrame:
    """Rules 1.6, 1.1 and 9.3 of the phrases found."""
    rows = spans.withColumn("key", F.col("phrase")).join(F.broadcast(lex.rows), "key")
    at = F.col("col") + F.col("start")
    term = finding(rows.where("kind = 'term' and collision"), "1.6", F.concat(quoted(F.col("key")), F.lit(" is a listed term, but a disallowed word")), F.concat(F.lit("confirm the term; otherwise use "), first_of("alt_words", 3)), ADVISORY, F.col("key"), at, 1)
    two = F.split("key", " ")
    phrasal = (F.size(two) == 2) & F.element_at(two, 2).isin(*C.PARTICLES)
    bad = finding(rows.where("kind = 'bad'"), F.when(phrasal, "9.3").otherwise("1.1"), F.concat(quoted(F.col("key")), F.lit(" is not approved")), first_of("labels", 4), VIOLATION, None, at, 2)
    return term.unionByName(bad)


def word_verdicts(lex: Lexicon) -> DataFrame:
    """What the lexicon says of each of its words, with all that a finding of it says behind the word itself: made once for a word, not for each token.

    said and instead are of an approved word in another role, of a listed
    term, of a noun and of a disallowed word. noun: whether the word may be a
    noun anywhere, or behind a determiner only.
    """
    slash = lambda c: F.array_join(c, "/")
    wrong = F.filter("bad_pos", lambda p: ~F.array_contains("good_pos", p))
    roles = F.when(F.col("self_alternative"), F.array(*map(F.lit, ("v", "adj", "adv", "n")))).otherwise(F.array(*map(F.lit, ("v", "adj", "adv"))))
    noun = (F.size("bad_pos") > 0) & (F.size(F.array_except("bad_pos", roles)) == 0)
    role = slash(F.array_sort(F.array_distinct("bad_pos")))
    role = F.when(role == "", "this sense").otherwise(role)
    approved_as = F.when(F.size("good_pos") > 0, F.concat(F.lit("; approved as "), slash("good_pos"))).otherwise("")
    return lex.rows.select(
        F.col("key").alias("__key"),
        "domain",
        "as_written",
        "approved",
        (F.size("labels") == 0).alias("bare"),
        F.when(noun, F.col("self_alternative")).alias("noun"),
        F.when(F.col("collision"), F.concat(F.lit(" is a listed term, but disallowed as "), role, approved_as)).alias("term_said"),
        F.when(F.size("alt_words") > 0, F.concat(F.lit("confirm the term; as "), role, F.lit(" use "), first_of("alt_words", 3))).otherwise("confirm the term").alias("term_instead"),
        F.when(F.col("unapproved") & (F.size(wrong) > 0), F.concat(F.lit(" is approved as "), slash("good_pos"), F.lit(", not as "), slash(wrong))).alias("pos_said"),
        first_of("labels", 3).alias("pos_instead"),
        F.concat(F.lit(" is not approved as "), slash("bad_pos"), F.lit("; here it may be a noun")).alias("noun_said"),
        F.concat(F.lit("confirm the noun; for a verb use "), first_of("labels", 3)).alias("noun_instead"),
        first_of("labels", 4).alias("bad_instead"),
    )


def word_findings(toks: DataFrame, lex: Lexicon) -> DataFrame:
    """Rules 1.14, 1.6, 1.2 and 1.1 of single words: the first rung of the ladder that a token meets decides.

    Tokens are words of ASCII letters, hyphens and apostrophes that begin with
    a letter, so an edge is trimmed at their ends only and a letter's case
    shows in its order.
    """
    word, offset, edge = F.col("word"), F.col("offset"), F.lit(C.EDGE)
    determined = F.col("determined") if "determined" in toks.columns else F.coalesce(F.lower("prev_word").isin(*C.DETERMINERS), F.lit(False))
    toks = toks.withColumn("key", F.rtrim(F.lower(word), edge))
    rows = toks.where((F.length("key") > 1) & ~F.col("key").contains("'") & ~F.col("key").contains("’") & ~F.col("key").isin(*C.SAFETY))
    rows = rows.join(F.broadcast(word_verdicts(lex)), F.col("key") == F.col("__key"), "left")
    british = F.create_map(*(F.lit(x) for kv in C.BRITISH.items() for x in kv))
    listed = F.col("domain") | F.array_contains("as_written", F.rtrim(word, edge))
    proper = (offset > 0) & (word < "a") & (word != F.upper(word))
    rung = (
        F.when(F.col("key").isin(*C.BRITISH), "british")
        .when(listed, F.when(F.col("term_said").isNotNull(), "term"))
        .when(F.col("approved"), F.when(F.col("pos_said").isNotNull(), "pos"))
        .when(proper, None)
        .when(F.coalesce(F.col("bare"), F.lit(True)), "unknown")
        .when(F.col("noun") | (F.col("noun").isNotNull() & determined), "noun")
        .otherwise("bad")
    )
    rows = rows.withColumn("rung", rung).where("rung is not null")
    rung = F.col("rung")
    of = lambda british, term, pos, unknown, noun, bad: F.when(rung == "unknown", unknown).when(rung == "bad", bad).when(rung == "pos", pos).when(rung == "noun", noun).when(rung == "term", term).otherwise(british)
    rule = F.when(rung == "british", "1.14").when(rung == "pos", "1.2").when(rung == "bad", "1.1").otherwise("1.6")
    said = of(F.lit(" is a British spelling"), F.col("term_said"), F.col("pos_said"), F.lit(f" is {UNKNOWN}"), F.col("noun_said"), F.lit(" is not approved"))
    instead = of(british[F.col("key")], F.col("term_instead"), F.col("pos_instead"), F.lit(KEEP), F.col("noun_instead"), F.col("bad_instead"))
    severity = F.when(rung.isin("british", "bad"), VIOLATION).otherwise(ADVISORY)
    return finding(rows, rule, F.concat(quoted(word), said), instead, severity, F.col("key"), F.col("col") + offset, 3)


def unknown_findings(toks: DataFrame) -> DataFrame:
    """Rule 1.6 of words that are in no dictionary: ``word_findings`` of these, without asking the lexicon again."""
    return finding(toks, "1.6", F.concat(quoted(F.col("word")), F.lit(f" is {UNKNOWN}")), KEEP, ADVISORY, F.rtrim(F.lower("word"), F.lit(C.EDGE)), F.col("col") + F.col("offset"), 3)


# --- verbs and gerunds -----------------------------------------------------------------


def each_match(sents: DataFrame, pattern: str, *groups: int) -> DataFrame:
    """(doc_row, doc_id, sent_id, line, col, text, start, hit, g1, g2): one row for each match in a sentence."""
    hits = sents.where(F.col("text").rlike(pattern)).select(*DOC, "sent_id", "line", "col", "text", F.explode(match_all(F.col("text"), pattern.replace("(?iU)", "(?iU)"))).alias("m"))
    out = hits.select(*DOC, "sent_id", "line", "col", "text", F.col("m.start").alias("start"), F.col("m.text").alias("hit"))
    return out.withColumns({f"g{g}": F.lower(F.regexp_extract("hit", pattern, g)) for g in groups})


# --- fixed values: patterns of the verb rules ---
PERFECT = r"(?iU)\b(?:have|has|had)\s+(?:been\s+)?(\w+ed|\w+en)\b"
PROGRESSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+(\w+ing)\b"
AUXILIARY = r"(?iU)\b(?:should|would|could|might|may|shall|ought)\b"
PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been)\s+(?:\w+ly\s+)?(\w+)\b"


def verb_findings(sents: DataFrame, lex: Lexicon) -> DataFrame:
    """Rules 3.2, 3.4 and 3.6."""
    at, q = F.col("col") + F.col("start"), quoted(F.col("hit"))
    asked = lambda pattern, hint: lex.look_up(each_match(where_may(sents, hint), pattern, 1), F.col("g1"), "participle", "good_pos")
    participle = F.coalesce(F.col("participle"), F.lit(False))
    perfect = asked(PERFECT, W.PERFECT).where(participle | (F.length("g1") >= 6))
    out = finding(perfect, "3.2", F.concat(q, F.lit(" is a perfect tense")), "a simple past or present tense", col=at, seq=4)
    adjective = F.coalesce(F.array_contains("good_pos", "adj"), F.lit(False)) | F.col("listed")
    progressive = asked(PROGRESSIVE, W.PROGRESSIVE).where(~adjective)
    out = out.unionByName(finding(progressive, "3.2", F.concat(q, F.lit(" is a progressive tense")), "a simple present or past tense", col=at, seq=5))
    out = out.unionByName(finding(each_match(where_may(sents, W.AUXILIARY), AUXILIARY), "3.4", F.concat(q, F.lit(" is not an approved auxiliary")), "CAN, MUST, or WILL", col=at, seq=6))
    passive = asked(PASSIVE, W.PASSIVE).where(~F.col("g1").isin(*C.FUNCTION_WORDS) & (participle | (F.col("g1").endswith("ed") & (F.length("g1") > 4))))
    after = F.regexp_replace(F.lower(F.expr("substring(text, start + length(hit) + 1, 6)")), r"(?U)^\s+", "")
    agent = after.startswith("by")
    said = F.concat(q, F.lit(" is passive"), F.when(agent, " with a named agent").otherwise("; confirm that it describes a condition"))
    return out.unionByName(finding(passive, "3.6", said, "the active voice, with a named doer", F.when(agent, VIOLATION).otherwise(ADVISORY), col=at, seq=7))


def gerund_findings(toks: DataFrame, lex: Lexicon) -> DataFrame:
    """Rule 3.5."""
    rows = toks.withColumn("low", F.lower("word")).where(F.col("low").endswith("ing") & (F.length("low") >= 6) & ~F.col("low").isin(*C.SAFETY))
    rows = lex.look_up(rows, F.col("low"), "approved").where(~F.col("listed") & ~F.coalesce(F.col("approved"), F.lit(False)))
    rows = rows.join(F.broadcast(lex.inflected(C.GERUND_SUFFIXES)), F.col("low") == F.col("form"))
    return finding(rows, "3.5", F.concat(quoted(F.col("word")), F.lit(' is the "-ing" form of '), F.upper("stem")), "only as a technical noun or a part of one", ADVISORY, F.col("low"), F.col("col") + F.col("offset"), 8)


# --- shape ---------------------------------------------------------------------------------


def cluster_findings(sents: DataFrame, lex: Lexicon) -> DataFrame:
    """Rule 2.1: runs of more than three content words. The word after a punctuation mark is in no run."""
    own = sents if "clusters" in sents.columns else with_words(sents, lex)
    runs = own.select(*DOC, "sent_id", "line", "col", F.explode("clusters").alias("r")).select(*DOC, "sent_id", "line", "col", "r.*")
    said = F.concat(quoted(F.col("words")), F.lit(" may be a noun of "), F.col("n").cast("string"), F.lit(f" words; the limit is {C.WORDS_CLUSTER}"))
    return finding(runs, "2.1", said, "break it up with prepositions", ADVISORY, col=F.col("col") + F.col("start"), seq=13)


def shape_findings(sents: DataFrame, lex: Lexicon) -> DataFrame:
    """Rules 5.1, 6.3, 5.2, 8.1 and 4.2."""
    limit = F.when(F.col("procedural"), C.WORDS_PROCEDURAL).otherwise(C.WORDS_DESCRIPTIVE)
    long = sents.where(F.col("n_words") > limit)
    kind = F.when(F.col("procedural"), "procedural").otherwise("descriptive")
    out = finding(long, F.when(F.col("procedural"), "5.1").otherwise("6.3"), F.concat(F.lit("sentence of "), F.col("n_words").cast("string"), F.lit(" words; the limit is "), limit.cast("string"), F.lit(" for "), kind, F.lit(" text")), "split it in two", seq=9)
    joint = sents.where(F.col("procedural") & F.col("text").rlike(r"(?iU)\band\b"))
    parts = joint.select(*DOC, "sent_id", "line", "col", F.explode(F.transform(F.split("text", r"(?iU)\band\b"), strip)).alias("part"))
    two = with_command(parts, deciding_word(F.col("part")), lex, "command").where("command").groupBy(*DOC, "sent_id", "line", "col").agg(F.count(F.lit(1)).alias("commands")).where("commands > 1")
    out = out.unionByName(finding(two, "5.2", F.lit("more than one instruction in a sentence"), "one instruction for each sentence", ADVISORY, seq=10))
    semi = sents.where(F.col("text").contains(";"))
    out = out.unionByName(finding(semi, "8.1", F.lit("a semicolon is not permitted"), "a period, or a vertical list", col=F.col("col") + F.instr("text", ";") - 1, seq=11))
    short = r"(?iU)\b(?:" + "|".join(C.CONTRACTIONS) + r")\b"
    hit = where_may(sents, W.SHORT).where(F.col("text").rlike(short)).withColumn("hit", F.regexp_substr("text", F.lit(short)))
    return out.unionByName(finding(hit, "4.2", F.concat(quoted(F.col("hit")), F.lit(" is a contraction")), "the full form", col=F.col("col") + F.regexp_instr("text", F.lit(short)) - 1, seq=12))


def paragraph_findings(sents: DataFrame) -> DataFrame:
    """Rule 6.6."""
    many = sents.groupBy(*DOC, "paragraph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sent_id", "line", "col")).alias("f")).where(F.col("n") > C.SENTENCES_PARAGRAPH)
    rows = many.select(*DOC, F.col("f.line").alias("line"), F.col("f.col").alias("col"), "n")
    return finding(rows, "6.6", F.concat(F.lit("paragraph of "), F.col("n").cast("string"), F.lit(f" sentences; the limit is {C.SENTENCES_PARAGRAPH}")), "split it in two", seq=14)


def may_have_labels(text: Column) -> Column:
    """Whether a text can have a line with a safety label: it holds one of the words, or a link, whose removal could make one.

    Lines need cleaning, which is most of the work of the safety rules, only where this is true.
    """
    # an array of one, so that a text is put in lower case once
    said = F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, (low.contains(w) for w in C.SAFETY)))
    return said | text.contains("](")


def safety_findings(docs: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """Rules 7.2 and 7.3, of documents with their lines. fix_quirks looks for whole label words and lets a label without a colon keep its line's rest."""
    bare = F.transform("lines", lambda x: strip(x["text"]))
    near = lambda i: F.coalesce(*(F.nullif(F.get("bares", i + k), F.lit("")) for k in (1, 2)))
    rows = once(docs, bares=bare).select(*DOC, F.posexplode(F.transform("bares", lambda x, i: F.struct(x.alias("bare"), near(i).alias("next")))).alias("i", "b"))
    lines = rows.select(*DOC, (F.col("i") + 1).alias("line_no"), "b.*")
    label = r"(?i)^(?:" + "|".join(C.SAFETY) + ")" + (r"\b" if fix_quirks else "")
    rows = lines.where(F.col("bare").rlike(label))
    own = F.when(F.col("bare").contains(":"), strip(F.regexp_replace("bare", r"^[^:]*:", ""))).otherwise(strip(F.regexp_replace("bare", label, "")) if fix_quirks else F.lit(""))
    rows = rows.withColumn("body", F.coalesce(F.nullif(own, F.lit("")), "next")).withColumn("line", F.col("line_no")).withColumn("col", F.lit(1))
    out = finding(rows.where("body is null"), "7.2", F.lit("a safety label with no command or condition"), seq=15)
    opener = F.lower(F.regexp_extract("body", "^[A-Za-z]+", 0))
    out = out.unionByName(finding(rows.where(opener.isin(*C.DESCRIPTION_OPENERS)), "7.2", F.lit("a safety instruction starts with a command or a condition, not a description"), seq=16))
    why = F.lit(False)
    for p in C.RISK_PHRASES:
        why = why | F.lower("body").contains(p)
    bald = rows.where(F.col("body").isNotNull() & (F.regexp_count("body", F.lit("[.!?]")) < 2) & ~why)
    return out.unionByName(finding(bald, "7.3", F.lit("a safety instruction gives no risk or result"), "add what can happen", seq=17))

