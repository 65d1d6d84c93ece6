"""Words of sentences where what stands beside a word matters: places, phrases, runs of content words.

A sentence is worked on inside its row, by one small helper over Arrow
batches, whose characters and words are arrays, so that neither its words nor what was found need an exchange to
come together again. What a word means is decided by joins, in ``rules``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosegauge.functions import constants as C
from prosegauge.functions.text import CLOSE, OPEN
from prosegauge.operators.lines import DOC, with_lines
from prosegauge.operators.parts import SENTENCE, cutter, is_word, pieces
from prosegauge.sources.lexicon import Lexicon

#: What is known of each sentence: first is its first word in lower case.
ADDED = "hints int, n_toks int, first string, spans array<struct<start:int,end:int,phrase:string,kind:string>>, clusters array<struct<start:int,n:int,words:string>>"
#: determined: a determiner stands before the word; inside: it begins in a phrase.
WHOLE = "toks array<struct<start:int,text:string,determined:boolean,inside:boolean>>"
#: The words outside phrases that the lexicon has to be asked about, those that are in no dictionary, and forms of verbs by -ing.
SPLIT = "listed array<struct<start:int,text:string,determined:boolean>>, unlisted array<struct<start:int,text:string>>, gerunds array<struct<start:int,text:string>>"
#: The same with the words in no dictionary counted: for each document of a piece, at its first sentence there, each of them once, in alphabetical order, with its number and its first place. n_unlisted is their sum; cut says that the document has sentences in other pieces too.
COUNTS_OF = "listed array<struct<start:int,text:string,determined:boolean>>, unlisted array<struct<word:string,n:int,line:int,col:int>>, gerunds array<struct<start:int,text:string>>, n_unlisted int, cut boolean"
#: For counts by rule: the lists have equal words of a piece once, at its first sentence, with how often they stand there; a start is 0 or 1, the first place of a sentence or another. What begins in changed sentences is not counted: these have a changed word. long_paragraph is of the first sentence of one; sentences that no rule can ask for are left out.
TALLIED = "hints int, n_toks int, first string, spans array<struct<start:int,end:int,phrase:string,kind:string,times:int>>, listed array<struct<start:int,text:string,determined:boolean,times:int>>, gerunds array<struct<start:int,text:string,times:int>>, n_unlisted int, n_clusters int, changed boolean, long_paragraph boolean"
PARENS, QUOTES = re.compile(C.PARENS), re.compile(C.QUOTES)
#: Runs of letters and digits, which are word characters in Java too. Other signs for numbers, which are none there, are few; a text without any needs the plain pattern, which is much faster.
RUN, SIGNS = re.compile(r"[^\W_]+"), frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "No")
RUN_BUT_SIGNS = re.compile("[^\\W_" + "".join(sorted(SIGNS)) + "]+")
FUNCTION_WORDS, DETERMINERS, SUFFIXES = frozenset(C.FUNCTION_WORDS), frozenset(C.DETERMINERS), tuple(s for s, _ in C.VERB_SUFFIXES)
BREAKS, DETERMINES, GERUND, LISTED, UNLISTED, PROPER = (1 << i for i in range(6))
#: What a sentence may hold, so that patterns are only tried where they can match: forms of have, of be, of be and an -ing word, auxiliaries, straight apostrophes, forms of verbs by -ing; and whether its counted words may differ from its tokens.
PERFECT, PASSIVE, PROGRESSIVE, AUXILIARY, SHORT, ING, COUNTED = (1 << i for i in range(7))
ALL_HINTS = (1 << 7) - 1
HAVE, BE, MODAL = frozenset(("have", "has", "had")), frozenset(("is", "are", "was", "were", "be", "been", "being")), frozenset(("should", "would", "could", "might", "may", "shall", "ought"))
#: Letters beyond ASCII that patterns take for ASCII ones of another case.
CASED_LIKE_ASCII = "\u0130\u0131\u017f\u212a"
#: What a character is: of a word, its first letter, of a run of letters and digits, a mark between words, a sign that makes counted words differ, one that hides words, an apostrophe, CASED_LIKE_ASCII.
TAIL, HEAD, LETTER, STOP, COUNTS, HIDES, APOSTROPHE, CASED = (1 << i for i in range(8))
#: What a run of letters says of its sentence.
HAS, IS, MAY, PAST, GOING, PARTICIPLE, ANCHOR, CHANGED, AND = (1 << i for i in range(9))
ASCII = re.compile("[a-z]+")
PIECE_BYTES = 2 << 20
MOST_HELD = 500_000


def letters_of(low: str) -> list[str]:
    """The runs of letters and digits in a text."""
    return (RUN if low.isascii() or SIGNS.isdisjoint(low) else RUN_BUT_SIGNS).findall(low)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """What each character is, by code point."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if chr(c).isalnum() and chr(c) not in SIGNS]] = LETTER
    out[[c for c in range(0x110000) if chr(c).isdecimal()]] |= COUNTS
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for chars, kind in ((letters, TAIL | HEAD), (C.EDGE, TAIL), (',;:.()"', STOP), ('("' + OPEN + CLOSE, COUNTS | HIDES), ("'", APOSTROPHE), (CASED_LIKE_ASCII, CASED)):
        out[[ord(c) for c in chars]] |= kind
    return out


def code_of(word: str, verdicts: dict[str, bool], verbs: set[str], written: set[str], all_verbs: set[str], keys: set[str]) -> int:
    """What a word is to its neighbours: BREAKS if it ends a run of content words, DETERMINES if it is a determiner; GERUND if it may be a form of a verb by -ing.

    LISTED if the lexicon has to be asked about it, UNLISTED if it is in none;
    neither if no rule is about it. PROPER if it may be a name.
    """
    low = word.lower()
    key = low.rstrip(C.EDGE)
    code = DETERMINES if low in DETERMINERS else 0
    if len(key) > 1 and "'" not in key and "’" not in key and key not in C.SAFETY:
        code |= LISTED if key in keys or key in C.BRITISH else UNLISTED | PROPER if word < "a" and word != word.upper() else UNLISTED
    if low.endswith("ing") and has_stem(low, all_verbs, C.GERUND_SUFFIXES):
        code |= GERUND
    if word in written:
        return code
    breaks = verdicts.get(low)
    return code | BREAKS if (low in FUNCTION_WORDS or low.endswith(SUFFIXES) and has_stem(low, verbs) if breaks is None else breaks) else code


def has_stem(low: str, verbs: set[str], suffixes=C.VERB_SUFFIXES) -> bool:
    """Whether a word is a form of a verb: ``Lexicon.inflected``, the other way round."""
    for suffix, ending in suffixes:
        if low.endswith(suffix) and len(low) > len(suffix) + 1:
            full = low[: -len(suffix)] + ending
            if len(full) >= 3 and full in verbs or len(full) >= 4 and full[-1] == full[-2] and full[:-1] in verbs:
                return True
    return False


def run_code(run: str, participles: set[str] | None, starting: set[str], changed: frozenset[str]) -> int:
    """What a run of letters and digits, in lower case, says of its sentence. Words are of ASCII letters, so one may be part of a run."""
    code = HAS if run in HAVE else IS if run in BE else MAY if run in MODAL else 0
    code |= PAST if run.endswith("ed") else GOING if run.endswith("ing") else 0
    code |= PARTICIPLE if participles is None or run in participles else 0
    code |= ANCHOR if run in starting else 0
    code |= AND if run == "and" else 0
    return code | CHANGED if changed and (run in changed or not changed.isdisjoint(ASCII.findall(run))) else code


def hints_of(near: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """What sentences may hold, of PERFECT to SHORT and COUNTED, by their runs of letters and their characters: never less than they do.

    A passive needs a word in -ed or one of the participles, where these are runs of letters themselves.
    """
    has = lambda of, bits: of & bits > 0
    be = has(near, IS)
    each = ((PERFECT, has(near, HAS)), (PASSIVE, be & has(near, PAST | PARTICIPLE)), (PROGRESSIVE, be & has(near, GOING)), (AUXILIARY, has(near, MAY)), (SHORT, has(signs, APOSTROPHE)), (COUNTED, has(signs, COUNTS)))
    return np.where(has(signs, CASED), ALL_HINTS & ~ING, sum(hint * there for hint, there in each)).astype(np.int32)


def verdicts_of(lex: Lexicon) -> tuple[dict[str, bool], set[str], set[str], set[str]]:
    """For each listed word whether it ends a run; the verbs whose forms do; the terms that count as written only; all verbs."""
    verdicts = {}
    for key, w in lex.words.items():
        if w["domain"]:
            verdicts[key] = False
        elif key in FUNCTION_WORDS or w["closed"]:
            verdicts[key] = True
        elif w["approved"]:
            verdicts[key] = "v" in w["good_pos"] and not set(C.NOUN_LIKE) & set(w["good_pos"])
        elif w["noun_like"]:
            verdicts[key] = False
        elif w["verb"]:
            verdicts[key] = True
    verbs = {k for k, w in lex.words.items() if w["verb"] and not w["noun_like"]}
    return verdicts, verbs, {t for w in lex.words.values() for t in w["as_written"]}, {k for k, w in lex.words.items() if w["verb"]}


def participles_of(lex: Lexicon) -> set[str] | None:
    """The participles of a lexicon; None if there is one that is no run of letters."""
    listed = {k for k, w in lex.words.items() if w["participle"]}
    return listed if all(letters_of(k) == [k] for k in listed) else None


def anchored(lex: Lexicon) -> dict[str, list[tuple[int, str, str]]]:
    """(rank, phrase, kind) by the first run of letters and digits in a phrase; those without any are under ""."""
    out: dict[str, list[tuple[int, str, str]]] = {}
    for rank, (phrase, kind) in enumerate([*((p, "term") for p in lex.domain_phrases), *((p, "bad") for p in lex.bad_phrases)]):
        if any(map(is_word, phrase)):
            m = RUN_BUT_SIGNS.search(phrase)
            out.setdefault(m[0] if m else "", []).append((rank, phrase, kind))
    return out


def runs_changed(words: Iterator[str]) -> frozenset[str] | None:
    """The runs of letters and digits of changed words; None, for every sentence, if one has no such run."""
    each = [letters_of(w) for w in words]
    return frozenset(r for runs in each for r in runs) if all(each) else None


def may_have_phrase(chars: np.ndarray, begins: np.ndarray, runs: pa.DictionaryArray, anchor: np.ndarray, anchors: dict[str, list[tuple[int, str, str]]]) -> np.ndarray:
    """Which of the runs at ``anchor``, places among those that begin at ``begins``, stand in a phrase that begins with them, by its characters alone."""
    out = np.zeros(len(anchor), bool)
    of = runs.indices.to_numpy()[anchor]
    for word in np.unique(of).tolist():
        own = np.flatnonzero(of == word)
        at, text = begins[anchor[own]], runs.dictionary[word].as_py()
        for _, phrase, _ in anchors[text]:
            lead = RUN_BUT_SIGNS.search(phrase).start()
            rest = np.frombuffer(phrase[lead + len(text) :].encode("utf-32-le"), np.uint32)
            fits = np.flatnonzero(at + len(text) + len(rest) <= len(chars))
            for k, c in enumerate(rest.tolist(), len(text)):
                fits = fits[chars[at[fits] + k] == c]
            out[own[fits]] = True
    return out


def spans_in(low: str, phrases: list[tuple[int, str, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, phrase, kind) of whole phrases in a text, by rank, then from left to right.

    Terms all count; of disallowed phrases, longer ones take the text first;
    a phrase never overlaps itself.
    """
    hits = []
    for rank, phrase, kind in phrases:
        at = low.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if is_word(low[at - 1 : at]) != is_word(low[at]) and is_word(low[end - 1]) != is_word(low[end : end + 1]):
                hits.append((rank, at, end, phrase, kind))
            at = low.find(phrase, at + 1)
    kept: list[tuple[int, int, str, str]] = []
    for _, at, end, phrase, kind in sorted(hits):
        if not any(a < end and at < b and (kind == "bad" or phrase == p) for a, b, p, _ in kept):
            kept.append((at, end, phrase, kind))
    return kept


def masked(text: str) -> str:
    """``functions.text.unquoted``, and without the signs that ``match_all`` takes out."""
    if OPEN in text or CLOSE in text:
        text = text.replace(OPEN, "").replace(CLOSE, "")
    if "(" in text or '"' in text:
        blanks = lambda m: " " * len(m[0])
        text = QUOTES.sub(blanks, PARENS.sub(blanks, text))
    return text


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts with a line feed behind each, and where each text begins, with the end of the last."""
    joined = "\n".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end."""
    edges = np.flatnonzero(np.diff(on.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def within(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from begins to ends one behind the other, and where each stretch starts among them."""
    at = np.concatenate(([0], np.cumsum(ends - begins)))
    return np.repeat(begins - at[:-1], ends - begins) + np.arange(at[-1]), at


def strings(chars: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The pieces of a text, each different one once."""
    places, at = within(begins, ends)
    own = chars[places]
    if own.size and own.max() > 0x7F:
        data = own.tobytes().decode("utf-32-le").encode()
        at = np.concatenate(([0], np.cumsum(1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF))))[at]
    else:
        data = own.astype(np.uint8).tobytes()
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()


def coded(words: pa.DictionaryArray, code, held: dict[str, int], plain) -> np.ndarray:
    """What ``code`` says of each word, asked once for each different one that ``plain`` does not tell of: its codes of all and which to ask about."""
    if len(held) >= MOST_HELD:
        held.clear()
    of, odd = plain(words.dictionary)
    odd = np.flatnonzero(odd)
    of[odd] = [held[w] if w in held else held.setdefault(w, code(w)) for w in words.dictionary.take(pa.array(odd)).to_pylist()]
    return of[words.indices.to_numpy()]


def flags(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def plain_runs(participles: set[str] | None, starting: set[str], changed: frozenset[str]):
    """For ``coded``: ``run_code`` of runs that are of ASCII letters and in no list."""
    lists = pa.array(HAVE | BE | MODAL | (participles or set()) | starting | changed | {"and"}, pa.string())

    def plain(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = flags(pc.is_in(runs, lists)) | ~flags(pc.match_substring_regex(runs, "^[a-z]+$"))
        return (PAST * flags(pc.ends_with(runs, "ed")) + GOING * flags(pc.ends_with(runs, "ing"))).astype(np.int32) | (PARTICIPLE if participles is None else 0), odd

    return plain


def plain_words(verdicts: dict[str, bool], verbs: set[str], written: set[str], all_verbs: set[str], keys: set[str]):
    """For ``coded``: ``code_of`` of words of letters that are in no list and have no ending of a verb."""
    lists = pa.array({*verdicts, *keys, *map(str.lower, written), *FUNCTION_WORDS, *DETERMINERS, *C.BRITISH, *C.SAFETY}, pa.string())
    endings = "(" + "|".join(SUFFIXES) + ")$"

    def plain(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.utf8_lower(words)
        odd = flags(pc.is_in(low, lists)) | flags(pc.match_substring_regex(low, f"[{C.EDGE}]|{endings}")) | flags(pc.equal(pc.utf8_length(low), 1))
        proper = flags(pc.match_substring_regex(words, "^[A-Z].*[a-z]"))
        return np.where(proper, UNLISTED | PROPER, UNLISTED).astype(np.int32), odd

    return plain


def long_paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches, which hold whole documents, cut, with whether a sentence is the first of a paragraph of too many."""
    for b in batches:
        paragraph = b.column(b.schema.get_field_index("paragraph")).to_numpy()
        begins = np.flatnonzero(document_begins(b) | (np.diff(paragraph, prepend=-1) != 0))
        out = np.zeros(b.num_rows, bool)
        out[begins] = np.diff(np.append(begins, b.num_rows)) > C.SENTENCES_PARAGRAPH
        at = 0
        for piece in pieces(iter([b]), PIECE_BYTES, 1 << 16):
            yield piece, out[at : at + piece.num_rows]
            at += piece.num_rows


def listed(rows: np.ndarray, n: int, /, **fields) -> pa.Array:
    """A list for each of n rows, of structs that stand in the order of their rows."""
    flat = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), flat)


def by_document(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches, which hold whole documents, cut behind documents, and whether a piece is part of one: documents beyond a piece are cut alone."""
    for b in batches:
        rows = max(1, min(most_rows, b.num_rows * most_bytes // max(1, b.nbytes)))
        ends = np.append(np.flatnonzero(document_begins(b))[1:], b.num_rows)
        at = 0
        while at < b.num_rows:
            within_piece = np.searchsorted(ends, at + rows, "right") - 1
            to, part = int(ends[within_piece]) if within_piece >= 0 else 0, False
            if to <= at:
                to, part = int(ends[np.searchsorted(ends, at, "right")]), True
            step = rows if part else to - at
            for x in range(at, to, step):
                yield b.slice(x, min(step, to - x)), part
            at = to


def document_begins(b: pa.RecordBatch) -> np.ndarray:
    """Whether a row is the first of its document in a batch."""
    rows = b.column(b.schema.get_field_index("doc_row"))
    return np.append(np.ones(min(1, len(rows)), bool), pc.fill_null(pc.not_equal(rows[1:], rows[:-1]), True).to_numpy(zero_copy_only=False))


def counts_of(b: pa.RecordBatch, words: pa.DictionaryArray, which: np.ndarray, sent: np.ndarray, start: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """unlisted and n_unlisted of COUNTS_OF, of the words at these places."""
    begins = document_begins(b)
    doc, heads = np.cumsum(begins) - 1, np.flatnonzero(begins)
    keys = pc.utf8_rtrim(pc.utf8_lower(words.dictionary), characters=C.EDGE).dictionary_encode()
    rank = np.empty(len(keys.dictionary), np.int64)
    rank[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(rank))
    at = sent[which]
    key = rank[keys.indices.to_numpy()][words.indices.to_numpy()[which]]
    line, col = (b.column(b.schema.get_field_index(c)).to_numpy()[at] for c in ("line", "col"))
    col = col + start[which]
    group = doc[at] * max(1, len(rank)) + key
    order = np.lexsort((line.astype(np.int64) << 32 | col, group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    n = np.diff(np.append(first, len(order))).astype(np.int32)
    first = order[first]
    total = np.zeros(b.num_rows, np.int32)
    total[heads] = np.bincount(doc[at], minlength=len(heads))
    return listed(heads[doc[at[first]]], b.num_rows, word=words.take(pa.array(which[first])).dictionary_decode(), n=n, line=line[first], col=col[first]), pa.array(total)


def tallies(n: int, key: np.ndarray, **fields) -> pa.Array:
    """A list at the first of n rows, of each different key with times; fields are functions of the keys."""
    each, times = np.unique(key, return_counts=True)
    return listed(np.zeros(len(each), np.int64), n, **{k: f(each) for k, f in fields.items()}, times=times.astype(np.int32))


def tallied(n: int, words: pa.DictionaryArray, sent: np.ndarray, start: np.ndarray, determined: np.ndarray, inside: np.ndarray, code: np.ndarray, spans: list[tuple], clusters: np.ndarray, changed: np.ndarray) -> list[pa.Array]:
    """The columns of TALLIED from spans on."""
    same = ~changed[sent]
    text = lambda at: words.dictionary.take(pa.array(at))
    own = same & ~inside & (code & LISTED > 0)
    key = words.indices.to_numpy().astype(np.int64)
    of_words = tallies(n, (key * 4 + determined * 2 + (start > 0))[own], start=lambda k: (k & 1).astype(np.int32), text=lambda k: text(k >> 2), determined=lambda k: k & 2 > 0)
    gerunds = tallies(n, key[same & (code & GERUND > 0)], start=lambda k: np.zeros(len(k), np.int32), text=text)
    kinds_of = sorted({s[3:] for s in spans})
    number = {x: i for i, x in enumerate(kinds_of)}
    none = lambda k: np.zeros(len(k), np.int32)
    phrases = tallies(n, np.array([number[s[3:]] for s in spans if not changed[s[0]]], np.int64), start=none, end=none, phrase=lambda k: pa.array([kinds_of[i][0] for i in k], pa.string()), kind=lambda k: pa.array([kinds_of[i][1] for i in k], pa.string()))
    unlisted = same & ~inside & (code & UNLISTED > 0) & ~((code & PROPER > 0) & (start > 0))
    total = lambda k: pa.array(np.append(k, np.zeros(n, np.int32))[:n].astype(np.int32))
    return [phrases, of_words, gerunds, total(unlisted.sum()), total((~changed[clusters]).sum()), pa.array(changed)]


def adder(lex: Lexicon, whole: bool = True, counted: bool = False, changed: DataFrame | None = None):
    """A function from batches of sentences to the same with the columns of ADDED, and of WHOLE, SPLIT or COUNTS_OF; or those of TALLIED, if ``changed(word)`` is given."""
    tally = changed is not None
    names = added(whole, counted, tally).names
    shared = lex.rows.sparkSession.sparkContext.broadcast((*verdicts_of(lex), set(lex.words), runs_changed(r.word for r in changed.collect()) if tally else frozenset(), participles_of(lex), anchored(lex)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *told, differing, participles, anchors = shared.value
        starting, anywhere = anchors.keys() - {""}, anchors.get("", [])
        plain_word, plain_run = plain_words(*told), plain_runs(participles, starting, differing or frozenset())
        held_words: dict[str, int] = {}
        held_runs: dict[str, int] = {}
        for b, cut in by_document(batches, PIECE_BYTES, 1 << 16) if counted else long_paragraphs(batches) if tally else ((b, False) for b in pieces(batches, PIECE_BYTES, 1 << 16)):
            texts, n = b.column(b.schema.get_field_index("text")).to_pylist(), b.num_rows

            def by_sentence(begin: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
                out, hit = np.zeros(n, np.int32), np.flatnonzero(bits)
                np.bitwise_or.at(out, np.searchsorted(begin, at[hit], "right") - 1, bits[hit])
                return out

            # what characters and runs of letters say of a sentence
            chars, begin = code_points(texts)
            kind = kinds()[chars]
            at = np.flatnonzero(kind & (COUNTS | HIDES | APOSTROPHE | CASED))
            signs = by_sentence(begin, at, kind[at])
            lows = [t.lower() for t in texts]
            low_chars, low_begin = code_points(lows)
            a, e = runs_of(kinds()[low_chars] & LETTER > 0)
            runs = strings(low_chars, a, e)
            near = coded(runs, lambda w: run_code(w, participles, starting, differing or frozenset()), held_runs, plain_run)
            anchor = np.flatnonzero(near & ANCHOR)
            anchor = anchor[may_have_phrase(low_chars, a, runs, anchor, anchors)]
            with_phrases = np.unique(np.searchsorted(low_begin, a[anchor], "right") - 1)
            near = by_sentence(low_begin, a, near)
            if participles is None:
                near |= PARTICIPLE

            # words, looked for where nothing is hidden; marks between them in the text as it is
            marks = kind & STOP > 0
            if (signs & HIDES).any():
                shown = [masked(t) if hides else t for t, hides in zip(texts, (signs & HIDES > 0).tolist(), strict=True)]
                marks = kinds()[code_points([t[: len(s)] for t, s in zip(texts, shown, strict=True)])[0]] & STOP > 0
                chars, begin = code_points(shown)
                kind = kinds()[chars]
            a, e = runs_of(kind & TAIL > 0)
            heads = np.append(np.flatnonzero(kind & HEAD), len(chars))
            a = heads[np.searchsorted(heads, a)]
            a, e = a[a < e], e[a < e]
            sent = np.searchsorted(begin, a, "right") - 1
            start = (a - begin[sent]).astype(np.int32)
            fresh = np.diff(sent, prepend=-1) > 0
            words = strings(chars, a, e)
            code = coded(words, lambda w: code_of(w, *told), held_words, plain_word)
            of = np.searchsorted(sent, np.arange(n + 1))

            # a word breaks a run by itself, or by a mark before it
            before = np.where(fresh, begin[sent], np.concatenate(([0], e[:-1])))
            passed = np.concatenate(([0], np.cumsum(marks)))
            broken = (passed[a] > passed[before]) & ~((a - before == 1) & (chars[a - 1] == ord(" ")))
            on = ~broken & (code & BREAKS == 0)
            first = np.flatnonzero(on & (fresh | ~np.concatenate(([False], on[:-1]))))
            last = np.flatnonzero(on & np.append(fresh[1:] | ~on[1:], True)) + 1
            first, last = first[last - first > C.WORDS_CLUSTER], last[last - first > C.WORDS_CLUSTER]
            places, at = within(first, last if not tally else first)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words.take(pa.array(places)).dictionary_decode()), " ")
            clusters = listed(sent[first], n, start=start[first], n=(last - first).astype(np.int32), words=joined)

            spans, inside = [], np.zeros(len(a), bool)
            for i in range(n) if anywhere else with_phrases.tolist():
                found = spans_in(lows[i], [*anywhere, *(p for w in starting.intersection(letters_of(lows[i])) for p in anchors[w])])
                spans += [(i, *span) for span in found]
                for x, y, _, _ in found:
                    inside[of[i] : of[i + 1]] |= (x <= start[of[i] : of[i + 1]]) & (start[of[i] : of[i + 1]] < y)
            rows, x, y, phrase, role = zip(*spans) if spans else ((),) * 5
            phrases = listed(np.array(rows, np.int64), n, start=pa.array(x, pa.int32()), end=pa.array(y, pa.int32()), phrase=pa.array(phrase, pa.string()), kind=pa.array(role, pa.string()))

            gerund = np.zeros(n, np.int32)
            gerund[sent[code & GERUND > 0]] = ING
            determined = ~fresh & np.concatenate(([False], code[:-1] & DETERMINES > 0))
            opening = pc.fill_null(pc.utf8_lower(words.take(pa.array(of[:-1], mask=of[:-1] == of[1:])).dictionary_decode()), "")
            made = [pa.array(hints_of(near, signs) | gerund), pa.array(np.diff(of).astype(np.int32)), opening, phrases, clusters]
            some = lambda which, **more: listed(sent[which], n, start=start[which], text=words.take(pa.array(np.flatnonzero(which))).dictionary_decode(), **{k: v[which] for k, v in more.items()})  # noqa: E731, B023
            if tally:
                odd = signs & CASED > 0 if differing is not None else np.ones(n, bool)
                odd |= np.fromiter((OPEN in t or CLOSE in t for t in texts), bool, n)
                odd |= near & CHANGED > 0
                made = [*made[:3], *tallied(n, words, sent, start, determined, inside, code, spans, sent[first], odd), pa.array(cut)]
                hints = made[0].to_numpy()
                asked = odd | cut | (hints & (ALL_HINTS & ~ING) > 0) | (near & AND > 0) | (np.diff(of) > min(C.WORDS_PROCEDURAL, C.WORDS_DESCRIPTIVE)) | flags(pc.match_substring(b.column(b.schema.get_field_index("text")), ";"))
                asked[:1] = True
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names]).filter(pa.array(asked))
                continue
            if whole:
                made.append(some(np.ones(len(a), bool), determined=determined, inside=inside))
            else:
                unlisted = ~inside & (code & UNLISTED > 0) & ~((code & PROPER > 0) & (start > 0))
                of_words, *totals = (*counts_of(b, words, np.flatnonzero(unlisted), sent, start), pa.array(np.full(n, cut))) if counted else (some(unlisted),)
                made += [some(~inside & (code & LISTED > 0), determined=determined), of_words, some(code & GERUND > 0), *totals]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    return add


def added(whole: bool, counted: bool = False, tally: bool = False) -> StructType:
    return StructType.fromDDL(TALLIED if tally else f"{ADDED}, {WHOLE if whole else COUNTS_OF if counted else SPLIT}")


def with_words(sents: DataFrame, lex: Lexicon, whole: bool = True) -> DataFrame:
    """sents with hints, n_toks, first, toks, spans (the phrases found) and clusters (runs of more than three content words).

    A word that follows a punctuation mark, or that breaks, is in no run.
    ``whole`` is as for ``sentences_with_words``.
    """
    return sents.mapInArrow(adder(lex, whole), StructType([*sents.schema.fields, *added(whole).fields]))


def sentences_with_words(docs: DataFrame, lex: Lexicon, fix_quirks: bool = False, whole: bool = True, counted: bool = False, changed: DataFrame | None = None) -> DataFrame:
    """``with_words(sentences(docs))``, with the lines' parts put together in the same pass over the batches.

    ``whole`` false gives in place of toks what the rules of single words ask
    for: listed, unlisted and gerunds. ``counted`` gives the unlisted ones
    counted; ``counted_words`` has them by document. ``changed(word)`` gives
    tallies for counts by rule in place of lists, without the sentences that
    have one of these words.
    """
    cut, add = cutter(fix_quirks), adder(lex, whole, counted, changed)
    rows = with_lines(docs).select(*DOC, "lines")
    return rows.mapInArrow(lambda batches: add(cut(batches)), StructType([*rows.schema.fields[: len(DOC)], *StructType.fromDDL(SENTENCE).fields, *added(whole, counted, changed is not None).fields]))


def counted_words(sents: DataFrame) -> DataFrame:
    """(doc_row, doc_id, unlisted): of each document, its words in no dictionary once each (word, n, line, col), of sentences that have them counted. Those of documents in pieces are put together."""
    some = sents.where("n_unlisted > 0")
    each = some.where("cut").select(*DOC, "sent_id", F.explode("unlisted").alias("u"))
    key = F.rtrim(F.lower("u.word"), F.lit(C.EDGE)).alias("key")
    each = each.groupBy(*DOC, key).agg(F.sum("u.n").cast("int").alias("n"), F.min(F.struct("u.line", "u.col", "sent_id", "u.word")).alias("f"))
    joined = each.groupBy(*DOC).agg(F.collect_list(F.struct("f.word", "n", "f.line", "f.col")).alias("unlisted"))
    return some.where("not cut").select(*DOC, "unlisted").unionByName(joined)


def words(sents: DataFrame, of: str = "toks") -> DataFrame:
    """(doc_row, doc_id, sent_id, line, col, offset, word, ...): one row for each word of a list of ``with_words``, with what else the list says of it."""
    rows = sents.select(*DOC, "sent_id", "line", "col", F.explode(of).alias("t"))
    more = [f"t.{f.name}" for f in rows.schema["t"].dataType.fields if f.name not in ("start", "text")]
    return rows.select(*DOC, "sent_id", "line", "col", F.col("t.start").alias("offset"), F.col("t.text").alias("word"), *more)
