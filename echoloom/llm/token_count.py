"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a string depends on its prefixes only. Distinct pre-tokens are inserted
in a trie; each new node gets the forward score of its prefix (best score over the vocabulary
entries that end there) and the number of tokens on that path, once for all pre-tokens that share
the prefix. A terminal node holds the count of its pre-token. Documents add up the counts.

Scores come from the vocabulary file: entry of rank r has Zipf weight -log2(r + 2), in integer
units, so sums are exact. Of equal scores the longest last token wins.

One pass over the rows without a shuffle; the trie belongs to the worker and is emptied when it is
full, which changes speed only.

Defined results for odd input: a NULL text is an empty one with count zero. Repeated rows are
counted each. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echoloom.llm.bpe import CHUNKS, MAX_NODES, PATTERN, REMEMBER, split_chunk

#: a remembered value is (pre-tokens << SHIFT) + tokens, so that values can be summed
SHIFT = 40
#: integer units of one bit of score
UNITS = 1 << 20
#: below any score that a text can reach
WORST = -(1 << 62)


def zipf_scores(path: str) -> dict[bytes, int]:
    """Token bytes and integer scores from a rank file."""
    with open(path, "rb") as f:
        ranks = dict(line.split() for line in f if line.strip())
    return {base64.b64decode(t): -round(math.log2(int(r) + 2) * UNITS) for t, r in ranks.items()}


class UnigramTrie:
    """Prefix trie of pre-tokens with forward scores.

    A node is an index into ``score`` (best score of its prefix), ``tokens`` (tokens on the best
    path); ``child`` maps node * 256 + byte to the next node.
    """

    def __init__(self, scores: dict[bytes, int]):
        import ahocorasick

        if any(bytes([b]) not in scores for b in range(256)):
            raise ValueError("every byte must be in the vocabulary")
        self.values, self.length, self.automaton = list(scores.values()), [len(t) for t in scores], ahocorasick.Automaton()
        for i, t in enumerate(scores):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0], [0]

    def insert(self, piece: bytes) -> int:
        """Walk or extend the trie along ``piece`` and return the terminal's token count."""
        child, score, tokens, values, length = self.child, self.score, self.tokens, self.values, self.length
        node, way = 0, [0]
        for b in piece:
            node = child.get(node << 8 | b)
            if node is None:
                break
            way.append(node)
        done = len(way) - 1
        if done < len(piece):
            for b in piece[done:]:
                child[way[-1] << 8 | b] = len(score)
                way.append(len(score))
                score.append(WORST)
                tokens.append(0)
            # entries that end at a position come longest first, so the longest wins a tie
            for end, t in self.automaton.iter(piece.decode("latin-1"), max(0, done - self.longest)):
                if end >= done:
                    before, node = way[end + 1 - length[t]], way[end + 1]
                    s = score[before] + values[t]
                    if s > score[node]:
                        score[node], tokens[node] = s, tokens[before] + 1
        return tokens[way[-1]]


class Tally(dict):
    """Pre-tokens and tokens of a chunk, filled on demand; emptied when full."""

    def __init__(self, trie: UnigramTrie, terminals: dict[str, int], prefix: str):
        import regex

        super().__init__()
        self.trie, self.terminals, self.prefix, self.pattern = trie, terminals, prefix, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> int:
        pieces, known, tokens = split_chunk(self.pattern, self.prefix, chunk), self.terminals, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.trie.insert(p.encode())
                if len(p) < 256:
                    known[p] = n
            tokens += n
        if len(self.trie.score) > MAX_NODES:
            self.trie.clear()
        if len(known) > REMEMBER:
            known.clear()
        if len(self) > REMEMBER:
            self.clear()
        made = (len(pieces) << SHIFT) + tokens
        if len(chunk) < 256:
            self[chunk] = made
        return made


class Counting:
    """What a worker needs; the tables are built once per process and kept with the broadcast value."""

    def __init__(self, path: str):
        self.scores, self._tables = zipf_scores(path), None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def count(self, text: str) -> tuple[int, int]:
        if self._tables is None:
            trie = UnigramTrie(self.scores)
            terminals: dict[str, int] = {}
            self._tables = Tally(trie, terminals, ""), Tally(trie, terminals, " ")
        if not text:
            return 0, 0
        first, later = self._tables
        chunks = CHUNKS.split(text)
        both = first[chunks[0]] + sum(map(later.__getitem__, chunks[1:]))
        return both >> SHIFT, both & ((1 << SHIFT) - 1)


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_pretokens``, ``n_tokens``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(Counting(path))         # about 2 MB, fixed by the file
    given = docs.select(docs[f"`{id_col}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    out = T.StructType([T.StructField(id_col, given.schema["k"].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = shared.value
        for b in batches:
            made = [counting.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())],
                                             [id_col, "n_pretokens", "n_tokens"])

    return given.mapInArrow(run, out)
