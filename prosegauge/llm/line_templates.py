"""Line dedup by a log-template tree (operator 4), in DataFrame operations only.

A line goes down a tree of fixed depth: its number of tokens, then its two
leading tokens, tokens with digits being variable fields. In a leaf, the
tokens behind the leading ones are cut into at most eight pieces. A template
is a leaf with the constant pieces of a line, the others being variable: a
line is like a template if at least five in eight of its pieces are the same,
so three of eight, two of six or one of three may vary. That is the one
threshold, a similarity; fields that lie side by side share a piece. A line
also stands for itself. Of the lines of a template that recurs in
``least_docs`` documents, all but the first are dropped.

What a template's lines are depends on them alone, so other text in a leaf
never hides one. Two sieves keep the work small: a line can only be generalised
if one part of it, of which a template leaves at least one whole, recurs in
another line of the leaf, and only pieces that recur so can be constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import materialise

LEAST_DOCS = 3
LEAST_TOKENS = 1
LEADING = 2
PIECES = 8
VARY = (3, 8)  # the share of a line's pieces in which it may differ from its template
VARIABLE = "<*>"
NAMES = [f"__p{k}" for k in range(PIECES)]


def masked_lines(text: Column) -> Column:
    """The lines of a text, tokens between single blanks; tokens with a digit are variable.

    Whether a text has digits or other blanks is looked up once, so most lines
    need no pattern at all.
    """
    raw = F.split(text, "\n")
    odd = text.contains("  ") | text.rlike(r"[0-9\x09\x0B-\x0D]")
    tidy = lambda x: F.when(x.contains("  ") | x.rlike(r"[\x09\x0B-\x0D]"), F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))).otherwise(F.trim(x))
    hide = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(tidy(x), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(tidy(x))
    return F.when(odd, F.transform(raw, hide)).otherwise(F.transform(raw, lambda x: F.trim(x)))  # noqa: PLW0108  F.trim itself would take the place for the characters to trim


def keyed(docs: DataFrame) -> DataFrame:
    """docs with an id and a text hash that name a document; equal rows are one document."""
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.col("text").cast("string"))})


def lines_of(docs: DataFrame) -> DataFrame:
    """(__id, __hash, line_no, n, body, of, __p0 ...) of each line with a token.

    ``body`` is the hash of the masked line, ``of`` the number of its pieces,
    and the others are theirs, which name leaf and place too; those from
    ``of`` on say nothing. No condition stands around them: the engine would
    work out the edges again for each.
    """
    cut = keyed(docs).select("__id", "__hash", F.posexplode(masked_lines(F.col("text").cast("string"))).alias("line_no", "line")).where("line <> ''")
    # A generator of one row: the line is split once, not once for each piece.
    cut = cut.select("__id", "__hash", "line_no", F.xxhash64("line").alias("body"), F.explode(F.array(F.split("line", " "))).alias("toks"))
    cut = cut.withColumn("n", F.size("toks")).withColumn("behind", F.greatest(F.col("n") - LEADING, F.lit(0)))
    cut = cut.withColumn("of", F.least("behind", F.lit(PIECES))).select("*", F.xxhash64("n", F.slice("toks", 1, LEADING)).alias("leaf"))
    edge = lambda k: F.expr(f"{LEADING} + behind * {k} div greatest(of, 1)").cast("int")
    piece = lambda k: F.xxhash64("leaf", F.lit(k), F.slice("toks", edge(k) + 1, edge(k + 1) - edge(k)))
    return cut.select("__id", "__hash", "line_no", "n", "body", "of", *(piece(k).alias(c) for k, c in enumerate(NAMES)))


def recurring(cells: DataFrame, least: int) -> DataFrame:
    """The ``cell`` values of ``cells(body, places, cell)`` that several lines have, in ``least`` places or more, with a check sum of the lines."""
    return (
        cells.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("places").alias("places"), F.bit_xor("body").alias("all"), F.min("body").alias("b0"), F.max("body").alias("b1"))
        .where((F.col("lines") > 1) & (F.col("places") >= least))
    )


def may_vary(of: int) -> int:
    return of * VARY[0] // VARY[1]


def by_pieces(make) -> Column:
    """``make(pieces, variable)`` for a line's own number of pieces and how many of them may be variable; null where none may."""
    out = F.lit(None)
    for of in range(1, PIECES + 1):
        if wild := may_vary(of):
            out = F.when(F.col("of") == of, make(of, wild)).otherwise(out)
    return out


def templates(lines: DataFrame, least_docs: int) -> DataFrame:
    """(body, template), several for a body, of the lines that templates generalise; of templates of the same lines there is one."""
    own = lines.where(F.col("of") * VARY[0] >= VARY[1]).groupBy("body").agg(F.count(F.lit(1)).alias("places"), *(F.max(c).alias(c) for c in ("of", *NAMES)))
    own = materialise(own, "zstd")
    # First sieve: of one part more than pieces may be variable, one at least is whole in all lines of a template.
    part = lambda of, wild, k: F.xxhash64(*(NAMES[i] for i in range(of) if i * (wild + 1) // of == k))
    parts = own.select("body", "places", F.explode(by_pieces(lambda of, wild: F.array(*(part(of, wild, k) for k in range(wild + 1))))).alias("cell"))
    again = materialise(recurring(parts, least_docs).select("cell"))  # a join of two exchanges is split at a hot cell
    near = parts.join(again.hint("merge"), "cell", "left_semi").select("body").distinct()
    near = materialise(own.join(near, "body"))
    # Second sieve: what is constant in a template recurs.
    pieces = near.select("body", "places", F.posexplode(F.slice(F.array(*NAMES), F.lit(1), F.col("of"))).alias("k", "cell"))
    again = materialise(recurring(pieces, least_docs).select("cell"))
    held = pieces.join(again.hint("merge"), "cell", "left_semi").groupBy("body").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("held"))
    held = materialise(near.join(held, "body"))
    # A template for each set of variable pieces that has all that do not recur; a set is the number whose bits are its pieces.
    sets = lambda of, wild: F.array(*(F.lit(m) for m in range(1, 1 << of) if m.bit_count() <= wild))
    fits = F.filter(by_pieces(sets), lambda m: F.col("held").bitwiseOR(m) == F.expr("shiftleft(1, of) - 1"))
    held = held.select("body", "places", F.slice(F.array(*NAMES), F.lit(1), F.col("of")).alias("cells"), F.explode(fits).alias("vary"))
    kept = F.filter("cells", lambda c, i: F.col("vary").bitwiseAND(F.pow(F.lit(2), i).cast("int")) == 0)
    keys = materialise(held.select("body", "places", F.xxhash64("vary", kept).alias("cell")))
    found = recurring(keys, least_docs).groupBy("lines", "all", "b0", "b1").agg(F.min("cell").alias("cell")).select("cell")
    return materialise(keys.join(materialise(found).hint("merge"), "cell").select("body", F.col("cell").alias("template")))


def line_marks(docs: DataFrame, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(__id, __hash, drops): for each document that loses lines, their numbers in order.

    Which line of a template is first is found for lines with the same body
    before it is for a template, so a line's places are joined once, however
    frequent it is and however many templates it has.
    """
    lines = materialise(lines_of(docs).where(F.col("n") >= least_tokens), "zstd")  # cut once, read by columns
    by_doc = materialise(lines.groupBy("body", "__id", "__hash").agg(F.min("line_no").alias("line_no")))
    in_docs = by_doc.groupBy("body").agg(F.count(F.lit(1)).alias("docs"))
    often = in_docs.where(F.col("docs") >= least_docs).select("body", F.col("body").alias("template"))
    members = materialise(templates(lines, least_docs).unionByName(often))
    here = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__hash", "line_no")
    # written before it is grouped: a frequent line's places are added up where they are, not in one task
    concerned = materialise(by_doc.join(materialise(members.select("body").distinct()).hint("merge"), "body", "left_semi"))
    bodies = materialise(concerned.groupBy("body").agg(F.count(F.lit(1)).alias("docs"), F.min(here).alias("first")))
    each = members.join(bodies, "body")
    all_ = each.groupBy("template").agg(F.max("docs").alias("most"), F.min("first").alias("first"))
    # Where no line alone is in enough documents, each is in few: those are counted.
    few = each.where(F.col("docs") < least_docs).select("template", "body").join(by_doc, "body").groupBy("template", "__id", "__hash").agg(F.lit(1)).groupBy("template").agg(F.count(F.lit(1)).alias("docs"))
    good = all_.join(few, "template", "left").where((F.col("most") >= least_docs) | (F.col("docs") >= least_docs)).select("template", "first")
    kept = materialise(members.join(good, "template").groupBy("body").agg(F.min("first").alias("first")))
    gone = lines.select("body", "__id", "__hash", "line_no").join(kept.hint("merge"), "body").where(here != F.col("first"))
    return gone.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("line_no")).alias("drops"))


def drop_lines(docs: DataFrame, counts: bool = True, **how) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from text; columns as given, with ``counts`` also n_lines and n_dropped.

    The first line of a template, by doc_id (nulls last), text hash and line,
    stays, unless it repeats a line before it by another template. Lines of
    fewer than ``least_tokens`` tokens never count. A null text stays null with
    no lines; a text may become empty, its row stays. Rows that repeat an id
    with its text are one document and share one fate. An empty table gives an
    empty result. A line of any length has at most eight pieces, so very long
    texts cost in proportion. Columns of any name are kept; those called
    n_lines or n_dropped are replaced only where ``counts`` asks for them.
    """
    marks = line_marks(docs, **how).select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), F.col("drops").alias("__drops"))
    out = keyed(docs).join(marks, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    text, drops = F.col("text").cast("string"), F.col("__drops")
    lines = F.split(text, "\n")
    # The dropped numbers are in order: what stands between two of them is a slice.
    edges = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(1), F.size(drops) + 1), lambda k: F.slice(lines, F.element_at(edges, k) + 2, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1))
    rest = F.when(drops.isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))
    added = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_dropped": F.coalesce(F.size(drops), F.lit(0)).cast("long")} if counts else {}
    kept = [rest.alias("text") if c == "text" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in added]
    return out.select(*kept, *(x.alias(c) for c, x in added.items()))


def drop_sql(table: str = "documents", least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS) -> str:
    """DuckDB SQL for :func:`drop_lines` over rows of different ids: every template of every line, with no sieve."""
    return rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {table} WHERE text IS NOT NULL)),
t AS (SELECT doc_id, no, list_transform(list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{VARIABLE}' ELSE w END) AS w FROM l),
n AS (SELECT *, w[{LEADING + 1}:] AS body, least(greatest(len(w) - {LEADING}, 0), {PIECES}) AS k FROM t WHERE len(w) >= {least_tokens}),
p AS (SELECT *, list_transform(range(k), lambda i: array_to_string(body[i * len(body) // k + 1 : (i + 1) * len(body) // k], ' ')) AS ps FROM n),
m AS (SELECT * FROM (SELECT *, unnest(range(1, (1 << k)::BIGINT)) AS mask FROM p WHERE k * {VARY[0]} >= {VARY[1]}) WHERE bit_count(mask) * {VARY[1]} <= k * {VARY[0]}),
named AS (
  SELECT doc_id, no, array_to_string(w, ' ') AS name FROM n
  UNION ALL SELECT doc_id, no, len(w) || chr(2) || array_to_string(w[:{LEADING}], ' ') || chr(2) || mask || chr(2) || array_to_string(list_transform(list_filter(range(k), lambda i: (mask >> i) & 1 = 0), lambda i: ps[i + 1]), chr(2)) FROM m
),
often AS (SELECT name, min(row(doc_id IS NULL, doc_id, no)) AS first FROM named GROUP BY name HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {least_docs}),
gone AS (SELECT DISTINCT doc_id, no FROM named JOIN often USING (name) WHERE row(doc_id IS NULL, doc_id, no) <> first),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS text, count(*) AS n_lines, count(g.no) AS n_dropped FROM l LEFT JOIN gone g ON g.no = l.no AND g.doc_id IS NOT DISTINCT FROM l.doc_id GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text FROM {table} d LEFT JOIN kept k ON k.doc_id IS NOT DISTINCT FROM d.doc_id
"""
