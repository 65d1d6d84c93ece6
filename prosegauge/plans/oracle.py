"""DuckDB SQL of the checking steps, as common table expressions.

RE2 has no look-ahead and its word classes are ASCII, so the white space after
a sentence end is put back, and letters of other scripts become _ where a
pattern asks for word boundaries.
"""

from __future__ import annotations

import re

from prosegauge.functions import constants as C


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(xs) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ascii_words(x: str) -> str:
    return rf"regexp_replace(replace({x}, '’', ''''), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', '_', 'g')"


ITEM = r"^\s*(?:[-*+]|\d+[.)]|[A-Z][.)])\s+"
BLOCK = r"^\s*(?:#{1,6}|[-*+]|\d+[.)]|[A-Z][.)])\s+"
TOKEN = "[A-Za-z][A-Za-z''’-]*"


def mask(x: str, pattern: str) -> str:
    cut = f"string_split(regexp_replace({x}, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    return f"array_to_string(list_transform({cut}, lambda p, i: CASE WHEN i = 1 THEN p ELSE repeat(' ', instr(p, chr(2)) - 1) || substr(p, instr(p, chr(2)) + 1) END), '')"


INLINE = r"regexp_replace(regexp_replace(regexp_replace(raw, '`[^`]*`', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+|www\.\S+', ' ', 'g')"
COUNT = r"""len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({m}, '\([^)]*\)', ' ONEWORD ', 'g'), '"[^"]*"', ' ONEWORD ', 'g'), '\b\d[\d,.]*\s*[A-Za-z%$/]*\b', ' ONEWORD ', 'g'), '[A-Za-z][A-Za-z''-]*'))"""


def base(docs: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs docs, raws, lines, parts, sents and toks over any rows of (doc_id, text)."""
    return rf"""
WITH docs AS ({docs}),
raws AS (
  SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS line_no FROM (
    SELECT doc_id, CASE WHEN ps[len(ps)] = '' THEN ps[1:len(ps) - 1] ELSE ps END AS ps
    FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ps FROM docs))
),
fences AS (
  SELECT *, regexp_matches(raw, '^\s*```') AS fence,
    sum(regexp_matches(raw, '^\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS inside, {strip('raw')} AS bare FROM raws
),
cleaned AS (
  SELECT doc_id, line_no, raw, {INLINE} AS inl,
    fence OR inside OR (contains(bare, '|') AND contains(bare, '-') AND regexp_full_match(bare, '[ :|\-]+')) AS gone,
    regexp_matches(raw, '^\s*\|.*\|\s*$') AND len(bare) - len(replace(bare, '|', '')) >= 2 AS is_row,
    regexp_matches(raw, '{BLOCK}') AS is_block, regexp_matches(raw, '{ITEM}') AS is_item
  FROM fences
),
celled AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace({strip('inl')}, '^\|+|\|+$', '', 'g'), '|'), lambda c: replace({strip('c')}, ':', ' ')), lambda c: c <> '') AS cells,
    regexp_extract(inl, '{BLOCK}') AS head FROM cleaned
),
lines AS (
  SELECT doc_id, line_no, CASE WHEN gone THEN '' WHEN is_row THEN CASE WHEN len(cells) > 0 THEN array_to_string(cells, '. ') || '.' ELSE '' END
      WHEN is_item THEN prose ELSE replace(prose, ':', ' ') END AS text,
    CASE WHEN gone THEN false WHEN is_row THEN true ELSE is_block END AS starts_block
  FROM (SELECT *, translate(repeat(' ', len(head)) || substr(inl, len(head) + 1), '*_>|', '    ') AS prose FROM celled)
),
blanks AS (SELECT *, NOT regexp_matches(text, '\S') AS is_blank FROM lines),
runs AS (SELECT *, coalesce(lag(is_blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS after_blank FROM blanks),
paras AS (
  SELECT *, sum((NOT after_blank AND (is_blank OR starts_block))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph, after_blank OR starts_block AS fresh FROM runs
),
pieces AS (
  SELECT doc_id, line_no, paragraph, fresh, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k, len(ps) AS n
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?:])(\s|$)', '\1' || chr(3) || '\2', 'g'), chr(3)) AS ps FROM paras WHERE NOT is_blank)
),
guards AS (SELECT *, k < n AND NOT regexp_matches({strip('piece')}, '\b{C.ABBREVIATIONS}\.$') AS ends FROM pieces),
groups AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM guards),
held AS (
  SELECT *, string_agg(piece, '') OVER (PARTITION BY doc_id, line_no, g ORDER BY k) AS part,
    coalesce(sum(CASE WHEN true THEN len(piece) END) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(len(piece)) OVER (PARTITION BY doc_id, line_no, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM groups
),
parts AS (
  SELECT doc_id, line_no, k, paragraph, fresh, part, ends, before - inside + len(part) - len(regexp_replace(part, '^\s+', '')) AS at0,
    row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) AS nth
  FROM held WHERE regexp_matches(part, '\S')
),
news AS (SELECT *, (coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY line_no, k), true) OR (nth = 1 AND fresh))::INT AS new FROM parts),
ids AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS sent_id FROM news),
sents AS (
  SELECT doc_id, sent_id::INT AS sent_id, arg_min(line_no, line_no * 1000000 + k)::INT AS line, (arg_min(at0, line_no * 1000000 + k) + 1)::INT AS col,
    {strip("string_agg(part, ' ' ORDER BY line_no, k)")} AS text, max(paragraph)::INT AS paragraph
  FROM ids GROUP BY doc_id, sent_id
),
counted AS (SELECT *, {COUNT.format(m=ascii_words('text'))} AS n_words FROM sents),
masked AS (SELECT *, {mask(mask('text', chr(92) + '([^)]*' + chr(92) + ')'), '"[^"]*"')} AS plain FROM sents),
marks AS (SELECT doc_id, sent_id, line, col, text, string_split(regexp_replace(plain, '({TOKEN})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps FROM masked),
cuts AS (SELECT doc_id, sent_id, line, col, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM marks),
placed AS (
  SELECT *, sum(len(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id, sent_id ORDER BY i) - len(replace(p, chr(2), '')) AS off FROM cuts
),
toks AS (
  SELECT *, lag(word) OVER (PARTITION BY doc_id, sent_id ORDER BY idx) AS prev_word, lead(word) OVER (PARTITION BY doc_id, sent_id ORDER BY idx) AS next_word,
    regexp_replace(lower(word), '^[''’-]+|[''’-]+$', '', 'g') AS key
  FROM (SELECT doc_id, sent_id, line, col, text, (i - 2)::INT AS idx, substr(p, 1, instr(p, chr(2)) - 1) AS word, off::INT AS "offset" FROM placed WHERE i > 1)
)
"""


def lexicon(entries, terms=()) -> str:
    """CTE lex over invented entries and terms: one row for each surface in lower case, with all that the rules ask of it."""
    rows: dict[str, dict] = {}

    def row(key: str) -> dict:
        return rows.setdefault(key, {"all": set(), "good": set(), "bad": [], "labels": [], "alts": set(), "self": False, "unapproved": False, "participle": False, "domain": False})

    for head, pos, approved, forms, note, _, alts, _, _ in entries:
        for s in [head, *forms]:
            row(s.lower())["all"].add(pos or "")
            for word in re.findall("[A-Za-z][A-Za-z'-]*", s) if approved else ():
                row(word.lower())["good"].add(pos or "phrase")
        if approved and pos == "v" and forms:
            row(forms[-1].lower())["participle"] = True
        if not approved:
            r = row(head.lower())
            r["unapproved"] = True
            r["bad"] += [pos] if pos else []
            r["labels"] += [f"{w} ({p})" if p else w for w, p, _, _ in alts] or ([note] if note else [])
            r["alts"] |= {w for w, *_ in alts}
            r["self"] |= any(w.lower() == head.lower() for w, *_ in alts)
    for term in terms:
        if term == term.lower():
            row(term)["domain"] = True
    flag = lambda x: str(bool(x)).lower()
    values = ", ".join(
        f"({text(k)}, {array(sorted(r['good']))}, {array(r['bad'])}, {array(dict.fromkeys(r['labels']))}, {array(sorted(r['alts']))}, {flag(r['self'])}, {flag('v' in r['all'])}, {flag(r['all'] & set(C.NOUN_LIKE))}, "
        f"{flag(r['all'] & set(C.CLOSED_CLASS) or r['all'] == {'adv'})}, {flag(r['participle'])}, {flag(r['unapproved'])}, {flag(r['domain'])})"
        for k, r in sorted(rows.items())
    )
    return f", lex(key, good, bad, labels, alts, self_alternative, verb, noun_like, closed, participle, unapproved, domain) AS (VALUES {values})"


def cased(terms) -> str:
    return array(t for t in terms if t != t.lower())


def phrases(entries, terms) -> str:
    """CTE spans: (doc_id, sent_id, line, col, s, e, phrase, kind), each phrase after those that come before it."""
    several = sorted({t.lower() for t in terms if " " in t}, key=lambda p: -len(p.split()))
    bad = sorted(dict.fromkeys(e[0].lower() for e in entries if " " in e[0] and not e[2]), key=lambda p: -len(p.split()))
    sql, before = "", ""
    for k, (phrase, kind) in enumerate([(p, "term") for p in several] + [(p, "bad") for p in bad]):
        sql += matches(rf"\b{re.escape(phrase).replace(chr(92) + ' ', ' ')}\b", name=f"ph{k}")
        clear = f"WHERE NOT EXISTS (SELECT 1 FROM spans{k - 1} t WHERE t.doc_id = h.doc_id AND t.sent_id = h.sent_id AND t.s < h.off + len(h.hit) AND h.off < t.e)" if kind == "bad" and k else ""
        own = f"SELECT doc_id, sent_id, line, base AS col, off AS s, off + len(hit) AS e, {text(phrase)} AS phrase, {text(kind)} AS kind FROM ph{k} h {clear}"
        sql += f", spans{k} AS MATERIALIZED ({before}{own})"
        before = f"SELECT * FROM spans{k} UNION ALL "
    return f"{sql}, spans AS (SELECT * FROM spans{k})"


def ladder(terms, spans: bool = False) -> str:
    """CTE rungs: the verdict on each token that no phrase covers."""
    det, british, safety = (array(x) for x in (C.DETERMINERS, C.BRITISH, C.SAFETY))
    free = 'AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND s.sent_id = t.sent_id AND t."offset" >= s.s AND t."offset" < s.e)' if spans else ""
    return f"""
, rungs AS MATERIALIZED (
  SELECT t.doc_id, t.sent_id, t.line, t.col + t."offset" AS col, t.word, t.key, l.good, l.bad, l.labels, l.alts,
    CASE WHEN list_contains({british}, t.key) THEN 'british'
      WHEN coalesce(l.domain, false) OR list_contains({cased(terms)}, regexp_replace(t.word, '^[''’-]+|[''’-]+$', '', 'g')) THEN CASE WHEN l.domain AND l.unapproved THEN 'term' END
      WHEN len(l.good) > 0 THEN CASE WHEN l.unapproved AND len(list_filter(l.bad, lambda p: NOT list_contains(l.good, p))) > 0 THEN 'pos' END
      WHEN regexp_matches(t.word, '^[A-Z]') AND regexp_matches(t.word, '[a-z]') AND t."offset" > 0 THEN NULL
      WHEN coalesce(len(l.labels), 0) = 0 THEN 'unknown'
      WHEN len(l.bad) > 0 AND len(list_filter(l.bad, lambda p: NOT (p IN ('v', 'adj', 'adv') OR (p = 'n' AND l.self_alternative)))) = 0
        AND (l.self_alternative OR coalesce(list_contains({det}, lower(t.prev_word)), false)) THEN 'noun'
      ELSE 'bad' END AS rung
  FROM toks t LEFT JOIN lex l ON l.key = t.key
  WHERE len(t.key) > 1 AND NOT regexp_matches(t.key, '[''’]') AND NOT list_contains({safety}, t.key) {free}
)
"""


def matches(pattern: str, source: str = "sents", name: str = "hits") -> str:
    """CTE ``name``: (doc_id, sent_id, line, base, col, off, hit, said, after) of a pattern.

    Letters of other scripts are masked for the search; places stay, so
    ``said`` is the match in the text itself.
    """
    m, c, p = f"{name}_m", f"{name}_c", f"{name}_p"
    return f"""
, {m} AS (SELECT doc_id, sent_id, line, col, text, string_split(regexp_replace({ascii_words('text')}, '({pattern})', chr(1) || '\\1' || chr(2), 'gi'), chr(1)) AS ps FROM {source}),
{c} AS (SELECT doc_id, sent_id, line, col, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM {m} WHERE len(ps) > 1),
{p} AS (SELECT *, sum(len(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id, sent_id ORDER BY i) - len(replace(p, chr(2), '')) AS off FROM {c}),
{name} AS MATERIALIZED (
  SELECT doc_id, sent_id, line, col AS base, (col + off)::INT AS col, off::INT AS off, substr(p, 1, instr(p, chr(2)) - 1) AS hit,
    substr(text, off::INT + 1, instr(p, chr(2)) - 1) AS said, lower(substr(text, off::INT + instr(p, chr(2)), 6)) AS after, text
  FROM {p} WHERE i > 1
)
"""


def stems(suffixes, least_double: int, word: str = "low") -> str:
    """The list of stems that a word may inflect, in order."""
    out = []
    for suffix, ending in suffixes:
        stem = f"substr({word}, 1, len({word}) - {len(suffix)}) || {text(ending)}"
        fits = f"ends_with({word}, {text(suffix)}) AND len({word}) > {len(suffix) + 1}"
        out += [f"CASE WHEN {fits} THEN {stem} END", f"CASE WHEN {fits} AND len({stem}) > {least_double} AND ({stem})[-1] = ({stem})[-2] THEN ({stem})[:-2] END"]
    return f"list_filter([{', '.join(out)}], lambda c: len(c) >= 3)"


def commands(source: str, name: str, entries) -> str:
    """CTE ``name``: (doc_id, sent_id, part, procedural) of the texts of ``source``."""
    verbs = sorted({w.lower() for e in entries if e[2] and e[1] == "v" for s in (e[0], *e[3]) for w in re.findall("[A-Za-z][A-Za-z'-]*", s)} - set(C.FUNCTION_WORDS))
    masked = mask(mask("tail", chr(92) + "([^)]*" + chr(92) + ")"), '"[^"]*"')
    return f"""
, {name}_t AS (SELECT doc_id, sent_id, part, i, array_to_string(ps[i:], ',') AS tail FROM (SELECT doc_id, sent_id, part, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, string_split(text, ',') AS ps FROM {source}))),
{name}_w AS (SELECT doc_id, sent_id, part, i, lower(regexp_extract({masked}, '{TOKEN}')) AS w FROM {name}_t),
{name} AS MATERIALIZED (
  SELECT doc_id, sent_id, part, coalesce(list_contains({array([*C.COMMANDS, *verbs])}, arg_min(w, i) FILTER (NOT list_contains({array(C.CONDITIONS)}, w))), false) AS procedural
  FROM {name}_w GROUP BY doc_id, sent_id, part
)
"""


def exact_round(x: str, digits: int) -> str:
    """A double rounded by its exact binary value, a tie to the even digit."""
    parts = f"((({x}) - floor({x})) * 9223372036854775808.0)::HUGEINT * {2 * 10**digits}"
    last = f"(({parts}) // 18446744073709551616::HUGEINT)"
    over = f"({parts} - (2 * {last} + 1) * 9223372036854775808::HUGEINT)"
    return f"((floor({x})::BIGINT * {10**digits} + {last}::BIGINT + CASE WHEN {over} > 0 OR ({over} = 0 AND {last} % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {10**digits})"


def findings(entries, terms) -> str:
    """CTE found: every finding in mode auto, with doc_id, sent_id, line, col, rule, message, suggestion, severity, term, seq."""
    q = lambda x: f"""'"' || {x} || '"'"""
    some = lambda x, n: f"array_to_string({x}[1:{n}], ', ')"
    role = "coalesce(nullif(array_to_string(list_sort(list_distinct(bad)), '/'), ''), 'this sense')"
    wrong = "array_to_string(list_filter(bad, lambda p: NOT list_contains(good, p)), '/')"
    british = "CASE key " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in C.BRITISH.items()) + " END"
    part = rf"lower(regexp_extract(hit, '(\w+)$', 1))"
    short = "|".join(C.CONTRACTIONS).replace("'", "''")
    label = "^(?:" + "|".join(C.SAFETY) + ")"
    risk = " OR ".join(f"contains(lower(body), {text(p)})" for p in C.RISK_PHRASES)
    return (
        phrases(entries, terms)
        + ladder(terms, spans=True)
        + matches(r"\b(?:have|has|had)\s+(?:been\s+)?(?:\w+ed|\w+en)\b", name="perfect")
        + matches(r"\b(?:is|are|was|were|be|been|being)\s+\w+ing\b", name="progressive")
        + matches(r"\b(?:should|would|could|might|may|shall|ought)\b", name="auxiliary")
        + matches(r"\b(?:is|are|was|were|be|been)\s+(?:\w+ly\s+)?\w+\b", name="passive")
        + matches(rf"\b(?:{short})\b", name="contraction")
        + ", whole AS (SELECT doc_id, sent_id, 1 AS part, text FROM sents)"
        + commands("whole", "proc", entries)
        + rf", pieces_of AS (SELECT doc_id, sent_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS part FROM (SELECT doc_id, sent_id, string_split_regex({ascii_words('text')}, '(?i)\band\b') AS ps FROM sents) WHERE len(ps) > 1)"
        + commands("pieces_of", "halves", entries)
        + f"""
, verb_sets AS (SELECT list(key) FILTER (verb) AS verbs, list(key) FILTER (verb AND NOT noun_like) AS plain FROM lex),
inner_words AS (
  SELECT t.*, lower(word) AS low, substr(text, prev_end + 1, "offset" - prev_end) AS gap, l.good, l.closed, l.noun_like, l.verb, l.domain
  FROM (SELECT *, coalesce(lag("offset" + len(word)) OVER (PARTITION BY doc_id, sent_id ORDER BY idx), 0) AS prev_end FROM toks) t LEFT JOIN lex l ON l.key = lower(t.word)
),
content AS (
  SELECT *, NOT ("offset" > 0 AND regexp_matches(gap, '[,;:.()"]')) AND NOT (CASE WHEN coalesce(domain, false) OR list_contains({cased(terms)}, word) THEN false
      WHEN list_contains({array(C.FUNCTION_WORDS)}, low) OR coalesce(closed, false) THEN true
      WHEN len(good) > 0 AND list_has_any(good, {array(C.NOUN_LIKE)}) THEN false
      WHEN len(good) > 0 THEN list_contains(good, 'v')
      WHEN coalesce(noun_like, false) THEN false
      ELSE coalesce(verb, false) OR list_has_any({stems(C.VERB_SUFFIXES, 2)}, plain) END) AS is_content
  FROM inner_words, verb_sets
),
cluster AS (
  SELECT doc_id, sent_id, line, col, min("offset") AS start, count(*) AS n, string_agg(word, ' ' ORDER BY idx) AS words
  FROM (SELECT *, sum((NOT is_content)::INT) OVER (PARTITION BY doc_id, sent_id ORDER BY idx) AS run FROM content) WHERE is_content
  GROUP BY doc_id, sent_id, line, col, run HAVING count(*) > {C.WORDS_CLUSTER}
),
gerund AS (
  SELECT *, list_filter({stems(C.GERUND_SUFFIXES, 3)}, lambda c: list_contains(verbs, c))[1] AS stem FROM inner_words, verb_sets
  WHERE ends_with(low, 'ing') AND len(low) >= 6 AND NOT (coalesce(domain, false) OR list_contains({cased(terms)}, word)) AND coalesce(len(good), 0) = 0 AND NOT list_contains({array(C.SAFETY)}, low)
),
near AS (
  SELECT doc_id, line_no, {strip('text')} AS bare,
    coalesce(nullif({strip('lead(text, 1) OVER w')}, ''), nullif({strip('lead(text, 2) OVER w')}, '')) AS next
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
),
labels AS (
  SELECT *, coalesce(nullif(CASE WHEN contains(bare, ':') THEN {strip("regexp_replace(bare, '^[^:]*:', '')")} ELSE '' END, ''), next) AS body
  FROM near WHERE regexp_matches(bare, '{label}', 'i')
),
long_or_not AS (SELECT c.*, p.procedural FROM counted c JOIN proc p USING (doc_id, sent_id)),
found AS MATERIALIZED (
  SELECT s.doc_id, s.sent_id, s.line, (s.col + s.s)::INT AS col, '1.6' AS rule, {q('phrase')} || ' is a listed term, but a disallowed word' AS message,
    'confirm the term; otherwise use ' || {some('l.alts', 3)} AS suggestion, 'advisory' AS severity, phrase AS term, 1 AS seq
  FROM spans s JOIN lex l ON l.key = s.phrase AND l.domain AND l.unapproved WHERE kind = 'term'
  UNION ALL SELECT s.doc_id, s.sent_id, s.line, (s.col + s.s)::INT, CASE WHEN len(string_split(phrase, ' ')) = 2 AND list_contains({array(C.PARTICLES)}, string_split(phrase, ' ')[2]) THEN '9.3' ELSE '1.1' END,
    {q('phrase')} || ' is not approved', {some('l.labels', 4)}, 'violation', '', 2 FROM spans s JOIN lex l ON l.key = s.phrase WHERE kind = 'bad'
  UNION ALL SELECT doc_id, sent_id, line, col::INT, CASE rung WHEN 'british' THEN '1.14' WHEN 'pos' THEN '1.2' WHEN 'bad' THEN '1.1' ELSE '1.6' END,
    {q('word')} || CASE rung WHEN 'british' THEN ' is a British spelling'
      WHEN 'term' THEN ' is a listed term, but disallowed as ' || {role} || CASE WHEN len(good) > 0 THEN '; approved as ' || array_to_string(good, '/') ELSE '' END
      WHEN 'pos' THEN ' is approved as ' || array_to_string(good, '/') || ', not as ' || {wrong}
      WHEN 'unknown' THEN ' is not in the dictionary'
      WHEN 'noun' THEN ' is not approved as ' || array_to_string(bad, '/') || '; here it may be a noun'
      ELSE ' is not approved' END,
    CASE rung WHEN 'british' THEN {british}
      WHEN 'term' THEN CASE WHEN len(alts) > 0 THEN 'confirm the term; as ' || {role} || ' use ' || {some('alts', 3)} ELSE 'confirm the term' END
      WHEN 'pos' THEN {some('labels', 3)}
      WHEN 'unknown' THEN 'keep a technical noun of the field and list it as a term'
      WHEN 'noun' THEN 'confirm the noun; for a verb use ' || {some('labels', 3)}
      ELSE {some('labels', 4)} END,
    CASE WHEN rung IN ('british', 'bad') THEN 'violation' ELSE 'advisory' END, key, 3 FROM rungs WHERE rung IS NOT NULL
  UNION ALL SELECT doc_id, sent_id, line, col, '3.2', {q('said')} || ' is a perfect tense', 'a simple past or present tense', 'violation', '', 4
    FROM perfect LEFT JOIN lex ON key = {part} WHERE coalesce(participle, false) OR len({part}) >= 6
  UNION ALL SELECT doc_id, sent_id, line, col, '3.2', {q('said')} || ' is a progressive tense', 'a simple present or past tense', 'violation', '', 5
    FROM progressive LEFT JOIN lex ON key = {part} WHERE NOT (coalesce(list_contains(good, 'adj'), false) OR coalesce(domain, false) OR list_contains({cased(terms)}, {part}))
  UNION ALL SELECT doc_id, sent_id, line, col, '3.4', {q('said')} || ' is not an approved auxiliary', 'CAN, MUST, or WILL', 'violation', '', 6 FROM auxiliary
  UNION ALL SELECT doc_id, sent_id, line, col, '3.6', {q('said')} || ' is passive' || CASE WHEN agent THEN ' with a named agent' ELSE '; confirm that it describes a condition' END,
    'the active voice, with a named doer', CASE WHEN agent THEN 'violation' ELSE 'advisory' END, '', 7
    FROM (SELECT *, {part} AS g, starts_with(regexp_replace(after, '^\\s+', ''), 'by') AS agent FROM passive) LEFT JOIN lex ON key = g
    WHERE NOT list_contains({array(C.FUNCTION_WORDS)}, g) AND (coalesce(participle, false) OR (ends_with(g, 'ed') AND len(g) > 4))
  UNION ALL SELECT doc_id, sent_id, line, (col + "offset")::INT, '3.5', {q('word')} || ' is the "-ing" form of ' || upper(stem), 'only as a technical noun or a part of one', 'advisory', low, 8 FROM gerund WHERE stem IS NOT NULL
  UNION ALL SELECT doc_id, sent_id, line, col, CASE WHEN procedural THEN '5.1' ELSE '6.3' END,
    'sentence of ' || n_words || ' words; the limit is ' || CASE WHEN procedural THEN '{C.WORDS_PROCEDURAL} for procedural text' ELSE '{C.WORDS_DESCRIPTIVE} for descriptive text' END, 'split it in two', 'violation', '', 9
    FROM long_or_not WHERE n_words > CASE WHEN procedural THEN {C.WORDS_PROCEDURAL} ELSE {C.WORDS_DESCRIPTIVE} END
  UNION ALL SELECT doc_id, sent_id, line, col, '5.2', 'more than one instruction in a sentence', 'one instruction for each sentence', 'advisory', '', 10
    FROM long_or_not WHERE procedural AND (doc_id, sent_id) IN (SELECT (doc_id, sent_id) FROM halves WHERE procedural GROUP BY doc_id, sent_id HAVING count(*) > 1)
  UNION ALL SELECT doc_id, sent_id, line, (col + instr(text, ';') - 1)::INT, '8.1', 'a semicolon is not permitted', 'a period, or a vertical list', 'violation', '', 11 FROM sents WHERE contains(text, ';')
  UNION ALL SELECT doc_id, sent_id, any_value(line), min(col), '4.2', {q('arg_min(said, col)')} || ' is a contraction', 'the full form', 'violation', '', 12
    FROM contraction WHERE NOT contains(said, '’') GROUP BY doc_id, sent_id
  UNION ALL SELECT doc_id, sent_id, line, (col + start)::INT, '2.1', {q('words')} || ' may be a noun of ' || n || ' words; the limit is {C.WORDS_CLUSTER}', 'break it up with prepositions', 'advisory', '', 13 FROM cluster
  UNION ALL SELECT doc_id, 1073741824, arg_min(line, sent_id), arg_min(col, sent_id), '6.6', 'paragraph of ' || count(*) || ' sentences; the limit is {C.SENTENCES_PARAGRAPH}', 'split it in two', 'violation', '', 14
    FROM sents GROUP BY doc_id, paragraph HAVING count(*) > {C.SENTENCES_PARAGRAPH}
  UNION ALL SELECT doc_id, 1073741824, line_no::INT, 1, '7.2', 'a safety label with no command or condition', '', 'violation', '', 15 FROM labels WHERE body IS NULL
  UNION ALL SELECT doc_id, 1073741824, line_no::INT, 1, '7.2', 'a safety instruction starts with a command or a condition, not a description', '', 'violation', '', 16
    FROM labels WHERE list_contains({array(C.DESCRIPTION_OPENERS)}, lower(regexp_extract(body, '^[A-Za-z]+')))
  UNION ALL SELECT doc_id, 1073741824, line_no::INT, 1, '7.3', 'a safety instruction gives no risk or result', 'add what can happen', 'violation', '', 17
    FROM labels WHERE body IS NOT NULL AND len(regexp_extract_all(body, '[.!?]')) < 2 AND NOT ({risk})
)
"""
    )


def statistics() -> str:
    """CTEs by_rule and stats over docs, counted, toks and found."""
    maps = lambda s: f"list((rule, n) ORDER BY rule) FILTER (severity = '{s}')"
    return f"""
, by_rule AS (SELECT doc_id, severity, rule, count(*) AS n FROM found GROUP BY ALL),
per_doc AS (SELECT doc_id, sum(n) FILTER (severity = 'violation') AS violations, sum(n) FILTER (severity = 'advisory') AS advisories, sum(n) FILTER (severity = 'violation' AND rule = '1.1') AS unapproved,
  string_agg(rule || '=' || n, ', ' ORDER BY rule) FILTER (severity = 'violation') AS hard, string_agg(rule || '=' || n, ', ' ORDER BY rule) FILTER (severity = 'advisory') AS soft FROM by_rule GROUP BY doc_id),
lengths AS (SELECT doc_id, count(*) AS sentences, sum(n_words)::BIGINT AS counted, max(n_words)::BIGINT AS most FROM counted GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS words FROM toks GROUP BY doc_id),
totals AS (
  SELECT d.doc_id, coalesce(l.sentences, 0) AS sentences, coalesce(l.counted, 0) AS counted_words, coalesce(l.most, 0) AS max_sentence_words, coalesce(s.words, 0) AS words,
    coalesce(p.violations, 0)::BIGINT AS violations, coalesce(p.advisories, 0)::BIGINT AS advisories, coalesce(p.unapproved, 0)::BIGINT AS unapproved_words, coalesce(p.hard, '') AS violations_by_rule, coalesce(p.soft, '') AS advisories_by_rule
  FROM docs d LEFT JOIN lengths l USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN per_doc p USING (doc_id)
),
stats AS (
  SELECT *, CASE WHEN sentences > 0 THEN {exact_round('counted_words / greatest(sentences, 1)', 1)} ELSE 0.0 END AS mean_sentence_words,
    CASE WHEN words > 0 THEN {exact_round('unapproved_words / greatest(words, 1)', 3)} ELSE 0.0 END AS unapproved_rate FROM totals
)
"""


def report() -> str:
    """CTE said: (doc_id, part, ord, said), the default report of each document."""
    first = "arg_min({0}, row(line, col, rule, sent_id, seq))"
    return f"""
, groups_of AS (
  SELECT doc_id, rule, coalesce(nullif(term, ''), message) AS what, count(*) AS n, min(line) AS first_line, {first.format('message')} AS message, {first.format('suggestion')} AS suggestion
  FROM found WHERE severity = 'advisory' GROUP BY ALL
),
unknown AS (SELECT doc_id, regexp_extract(message, '"([^"]+)"', 1) AS word, n FROM groups_of WHERE ends_with(message, ' is not in the dictionary')),
marked AS (SELECT doc_id, n > 1 OR contains(word, '-') OR regexp_matches(substr(word, 2), '[A-Z]') AS likely, CASE WHEN n > 1 THEN word || ' (' || n || 'x)' ELSE word END AS label FROM unknown),
buckets AS (SELECT doc_id, likely, count(*) AS n, string_agg(label, ', ' ORDER BY lower(label), label) AS words FROM marked GROUP BY ALL),
soft AS (
  SELECT doc_id, rule, what, 'RULE ' || rule || ' - ' || message || ' (' || CASE WHEN n > 1 THEN n || 'x, first at line ' || first_line ELSE 'line ' || first_line END || ')' || CASE WHEN suggestion <> '' THEN ' -- ' || suggestion ELSE '' END AS said
  FROM groups_of WHERE NOT ends_with(message, ' is not in the dictionary')
  UNION ALL SELECT doc_id, '1.6~', CASE WHEN likely THEN '0' ELSE '1' END,
    'RULE 1.6 - ' || n || ' words are not in the dictionary, ' || CASE WHEN likely THEN 'repeated, hyphenated or capitalized' ELSE 'used once' END || ': ' || words FROM buckets
),
hard AS (
  SELECT doc_id, line, col, rule, doc_id || ':' || line || ':' || col || ' - RULE ' || rule || ' - ' || message || CASE WHEN suggestion <> '' THEN ' -- use: ' || suggestion ELSE '' END AS said
  FROM found WHERE severity = 'violation'
),
summary AS (
  SELECT doc_id, unnest(list_filter([
    violations || ' violations, ' || advisories || ' advisories in ' || sentences || ' sentences (' || words || ' words)',
    'sentence length: mean ' || mean_sentence_words || ', max ' || max_sentence_words,
    'unapproved words: ' || unapproved_words || ' (' || printf('%.1f', unapproved_rate * 100) || '%)',
    CASE WHEN violations_by_rule <> '' THEN 'violations by rule: ' || violations_by_rule END,
    CASE WHEN violations = 0 THEN 'PASS: no rule is violated' END], lambda x: x IS NOT NULL)) AS said, generate_subscripts(list_filter([1, 2, 3, CASE WHEN violations_by_rule <> '' THEN 4 END, CASE WHEN violations = 0 THEN 5 END], lambda x: x IS NOT NULL), 1) - 1 AS ord
  FROM stats
),
said AS (
  SELECT doc_id, 1 AS part, row_number() OVER (PARTITION BY doc_id ORDER BY line, col, rule, said) - 1 AS ord, said FROM hard
  UNION ALL SELECT doc_id, 2, row_number() OVER (PARTITION BY doc_id ORDER BY rule, what, said) - 1, said FROM soft
  UNION ALL SELECT doc_id, 3, ord, said FROM summary
)
"""
