"""Sentences put together from a document's cleaned lines, over Arrow batches.

The same rows as ``sentences.sentences``, whose column expressions say what a
part and a sentence are and serve long documents too; this is the quick way
for checks, which go on with the words of a sentence in the same pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa

from prosegauge.functions.constants import ABBREVIATIONS
from prosegauge.operators.lines import DOC

SENTENCE = "sent_id int, line int, col int, text string, paragraph int"
CUT = "\x03"
#: White space in the sense of Java's Unicode classes.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ENDS = re.compile(rf"([.!?:])(?=[{BLANKS}]|$)")
GUARDS = tuple(a.replace("\\", "") + "." for a in ABBREVIATIONS[3:-1].split("|"))
WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}
PIECE_BYTES, PIECE_ROWS = 4 << 20, 4096


def is_word(ch: str) -> bool:
    """Whether a character is of words in the sense of Java's Unicode classes; "" is not."""
    return ch != "" and (unicodedata.category(ch) in WORD_KINDS or ch in "\u200c\u200d" or "\u24b6" <= ch <= "\u24e9" or "\U0001f130" <= ch <= "\U0001f149" or "\U0001f150" <= ch <= "\U0001f169" or "\U0001f170" <= ch <= "\U0001f189")


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = PIECE_BYTES, most_rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut, so that a worker holds the words of few megabytes at a time."""
    for b in batches:
        rows = max(1, min(most_rows, b.num_rows * most_bytes // max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def guarded(text: str) -> bool:
    """Whether a piece ends with an abbreviation, behind which no sentence ends."""
    return text.endswith(GUARDS) and any(text.endswith(g) and not is_word(text[-len(g) - 1 : -len(g)]) for g in GUARDS)


def parts_of(line: str, fix_quirks: bool) -> Iterator[tuple[int, str, bool]]:
    """(place from 0, text, ends) of what a line adds to the running sentence.

    Behind an abbreviation a part starts again where the last one did.
    """
    cut = ENDS.sub(rf"\1{CUT}", line).split(CUT)
    final, at, group = len(cut) - 1, 0, ""
    for i, piece in enumerate(cut):
        group += piece
        guard = i < final and guarded(piece)
        body = group.lstrip(BLANKS)
        if body and not (fix_quirks and guard):
            yield at + len(group) - len(body), group, i < final and not guard
        if not guard:
            at, group = at + len(group), ""


def sentences_of(lines: list[str], blocks: list[bool], fix_quirks: bool) -> Iterator[tuple[int, int, str, int]]:
    """(line, col, text, paragraph) of the sentences of a document's lines; blocks says which lines start one."""
    held: list[str] = []
    head, paragraph, after, ended = (0, 0, 0), 0, True, True
    for number, (line, block) in enumerate(zip(lines, blocks, strict=True), 1):
        empty = not line.strip(BLANKS)
        if not after and (empty or block):
            paragraph += 1
        if not empty:
            fresh = after or block
            for at, text, ends in parts_of(line, fix_quirks):
                if held and (ended or fresh):
                    yield head[0], head[1], " ".join(held).strip(BLANKS), head[2]
                    held = []
                if not held:
                    head = (number, at + 1, paragraph)
                held.append(text)
                ended, fresh = ends, False
        after = empty
    if held:
        yield head[0], head[1], " ".join(held).strip(BLANKS), head[2]


def cutter(fix_quirks: bool = False):
    """A function from batches of (doc_row, doc_id, lines) to those of their sentences, one row each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, ids, found = [], [], []
            lines = b.column(b.schema.get_field_index("lines"))
            flat = lines.flatten()
            texts, blocks = (flat.field(name).to_pylist() for name in ("text", "starts_block"))
            begin = 0
            for row, n in enumerate(lines.value_lengths().to_pylist()):
                end = begin + (n or 0)
                own = list(sentences_of(texts[begin:end], blocks[begin:end], fix_quirks))
                found += own
                rows += [row] * len(own)
                ids += range(1, len(own) + 1)
                begin = end
            line, col, text, paragraph = zip(*found) if found else ((),) * 4
            at = pa.array(rows, pa.int32())
            whole = [b.column(b.schema.get_field_index(c)).take(at) for c in DOC]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(ids, pa.int32()), pa.array(line, pa.int32()), pa.array(col, pa.int32()), pa.array(text, pa.string()), pa.array(paragraph, pa.int32())], names=[*DOC, "sent_id", "line", "col", "text", "paragraph"])

    return cut
