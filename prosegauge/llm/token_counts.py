"""Token counts by trie-shared dynamic programming (operator 7).

Distinct pre-tokens go into a trie. The best unigram score of a prefix, and
the number of pieces that give it, depend on the prefix alone, so each is
computed once, when its node is made; a pre-token's count is that of its last
node. Documents then only add up the counts of their pre-tokens.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import held, small

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_NODES = 1_500_000  # of one worker's trie; when full it starts anew
UNIT = 1_000_000  # scores are whole millionths of a nat, so sums are exact and ties are ties
START = "▁"


def vocabulary(path: str = MODEL) -> tuple[dict[str, int], int]:
    """The pieces of a tokenizer file with a log-probability each, and that of one byte of a character outside them.

    The file orders pieces by use and its scores are ranks, so probabilities
    follow Zipf's law over the rank; a byte is e**10 times rarer than the
    rarest piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    score = {p: round(UNIT * (-math.log(r + 2.7) - norm)) for r, p in enumerate(pieces)}
    return score, min(score.values()) - 10 * UNIT


class Trie(dict):
    """Maps a pre-token (UTF-8, without the leading blank) to its number of pieces."""

    def __init__(self, scores: dict[str, int], byte_score: int, most_nodes: int = MOST_NODES):
        super().__init__()
        self.scores, self.byte_score, self.most_nodes = scores, byte_score, most_nodes
        # lengths of the pieces with given last three characters, so that few suffixes of a prefix are looked up
        ends: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = {e: tuple(sorted(k)) for e, k in ends.items()}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best, self.count = [0], [0]

    def __missing__(self, raw: bytes) -> int:
        if len(self.best) > self.most_nodes:
            self.reset()
        word = START + raw.decode("utf-8", "replace")
        node, path = 0, [0]
        child, best, count, scores, ends = self.child, self.best, self.count, self.scores, self.ends
        for d in range(1, len(word) + 1):
            key = node * 0x110000 + ord(word[d - 1])
            node = child.get(key, 0)
            if not node:
                at = path[d - 1]
                s = scores.get(word[d - 1])
                n = 1
                if s is None:
                    n = len(word[d - 1].encode("utf-8", "replace"))
                    s = n * self.byte_score
                top, fewest = best[at] + s, count[at] + n
                for k in (2, *ends.get(word[d - 3 : d], ())) if d > 2 else (2,) if d == 2 else ():
                    if k <= d and (s := scores.get(word[d - k : d])) is not None:
                        at = path[d - k]
                        s += best[at]
                        if s > top or s == top and count[at] + 1 < fewest:
                            top, fewest = s, count[at] + 1
                node = child[key] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        self[raw] = count[node]
        return count[node]


@dataclass
class Shared:
    """A broadcast and a name for it that is the same in all processes."""

    broadcast: Broadcast
    id: str


def worker_trie(sent) -> Trie:
    """One trie serves all tasks of a worker."""
    return held(sent.id, lambda: Trie(*sent.broadcast.value))


def token_counts(docs: DataFrame, scores: dict[str, int] | None = None, byte_score: int | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of ``docs``.

    Pre-tokens are the runs of other characters than ASCII white space, each
    with one leading blank. A pre-token's pieces are those of the likeliest
    segmentation, of equals the one with the fewest; characters outside the
    vocabulary are one piece for each byte. Null and empty texts have none;
    repeated rows each keep their row; an empty table gives an empty result. A
    pre-token of any length is walked once; the trie starts anew when it is
    full. Only doc_id and text are read, so columns of other names cannot
    clash. The vocabulary, of fixed size, travels from the driver, so executors
    need no file.
    """
    if scores is None:
        scores, byte_score = vocabulary()
    sent = Shared(docs.sparkSession.sparkContext.broadcast((scores, byte_score)), uuid.uuid4().hex)

    def run(batches):
        trie = worker_trie(sent)
        get = trie.__getitem__
        for b in small(batches):
            words, pieces = [], []
            for t in b.column("text").to_pylist():
                own = (t or "").encode("utf-8", "replace").split()
                words.append(len(own))
                pieces.append(sum(map(get, own)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(words, np.int64)), pa.array(np.array(pieces, np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def counts_sql(scores: dict[str, int], byte_score: int, table: str = "documents") -> str:
    """DuckDB SQL for :func:`token_counts`: the best segmentation of each distinct pre-token, one character further in each round.

    A state is its score and the number of its pieces in one number, the lower
    number of pieces above. The vocabulary stands in the text as literals.
    """
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    one = 1 << 20  # more than the pieces of any pre-token
    return rf"""
WITH RECURSIVE pieces AS (SELECT unnest([{", ".join(map(quote, scores))}]) AS piece, unnest([{", ".join(map(str, scores.values()))}]::BIGINT[]) AS score),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM {table}),
u AS (SELECT rid, unnest(ws) AS w FROM d),
words AS (SELECT w, row_number() OVER () AS word, '{START}' || w AS t, len(w) + 1 AS n FROM (SELECT DISTINCT w FROM u)),
longest AS (SELECT max(len(piece)) AS most FROM pieces),
ends AS (SELECT word, t, unnest(range(1, n + 1)) AS d FROM words),
cuts AS (SELECT word, t, d, unnest(range(greatest(0, d - (SELECT most FROM longest)), d)) AS k FROM ends),
steps AS MATERIALIZED (
  SELECT word, d, k, score * {one} - 1 AS gain FROM cuts JOIN pieces ON piece = substr(t, k + 1, d - k)
  UNION ALL SELECT word, d, d - 1, octet_length(encode(substr(t, d, 1))) * ({byte_score} * {one} - 1) FROM ends WHERE substr(t, d, 1) NOT IN (SELECT piece FROM pieces)
),
walk(word, d, n, best) AS (
  SELECT word, 0::BIGINT, n, [0::BIGINT] FROM words
  UNION ALL SELECT w.word, w.d + 1, any_value(w.n), list_append(any_value(w.best), max(w.best[s.k + 1] + s.gain)) FROM walk w JOIN steps s ON s.word = w.word AND s.d = w.d + 1 WHERE w.d < w.n GROUP BY w.word, w.d
),
counted AS (SELECT w.w, ((-x.best[-1]) % {one} + {one}) % {one} AS k FROM walk x JOIN words w USING (word) WHERE x.d = x.n),
total AS (SELECT rid, sum(k)::BIGINT AS n_tokens FROM u JOIN counted USING (w) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_pretokens, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM d LEFT JOIN total USING (rid)
"""
