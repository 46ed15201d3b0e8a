"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token exactly one token can end its encoding. Candidates are all
vocabulary entries that end at the position (an automaton over the vocabulary finds them); one is
right if it can stand after the last token of the shorter prefix, which a pair test decides from
the merge list alone. Following the stored tokens backwards gives the encoding, without running
merges over the text.

Work is one pass over the rows without a shuffle. Encodings of chunks between single spaces are
remembered per worker in a table that is emptied when it is full; that changes speed only.

Defined results for odd input: a NULL text is an empty one, with no ids. Repeated rows are encoded
each. Special strings in a text become their own id, as in the tokenizer file. Columns beyond the
named ones are ignored. Any text can be encoded, since every byte is a token.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: entries of each per-worker table (chunks, pre-tokens) before it is emptied, and nodes of a trie;
#: together they take about 300 MB of a worker
REMEMBER = 350_000
MAX_NODES = 700_000
#: splits a text where any pre-tokenisation has a border: a single space between two visible characters
CHUNKS = re.compile(r"(?<=\S) (?=\S)")
#: how the tokenizer file splits text before merging (fixed value of the public tokenizer)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def split_chunk(pattern, prefix: str, chunk: str) -> list[str]:
    """Pre-tokens of a chunk without inner single spaces; plain words need no pattern."""
    if chunk.isalpha():
        return [prefix + chunk]
    if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
        return [prefix + chunk[:-1], chunk[-1]]
    return pattern(prefix + chunk)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: visible Latin-1 ones for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special strings of a byte-level tokenizer file; plain data, safe to broadcast.

    ``order[id]`` is the rank of the merge that makes a token (single bytes come first), and
    ``halves[id]`` the two tokens that it joins.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        alphabet, ids = byte_alphabet(), spec["model"]["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * self.size
        for piece, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in piece)
        for piece, i in self.special.items():
            self.bytes[i] = piece.encode()
        self.order = [-1] * self.size
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.joined: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, made = ids[left], ids[right], ids[left + right]
            self.joined[a, b] = rank
            if self.halves[made] is None:
                self.halves[made], self.order[made] = (a, b), rank
        self.tokens = [i for piece, i in ids.items() if len(self.bytes[i]) == 1 or self.halves[i]]
        self.length = [len(b) for b in self.bytes]
        self._coder: Coder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_coder": None}

    def coder(self) -> Coder:
        """The encoder of this process, built once and kept with the broadcast value."""
        if self._coder is None:
            self._coder = Coder(self)
        return self._coder


class Coder:
    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex

        self.v, self.pieces = v, regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for i in v.tokens:
            self.automaton.add_word(v.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(v.length)
        self.fits: dict[int, bool] = {}            # by last token << 17 | next token
        self.clear()
        self.whole: dict[int, bool] = {}
        self.known = Known(self)
        self.first, self.later = Remembered(self, ""), Remembered(self, " ")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of bytes(a) + bytes(b) is [a, b], given that each encodes to itself.

        Runs the two tokens' merges backwards, latest first. Between the undone merges the border
        has a left and a right neighbour; if those two had a merge that comes before the merge
        undone last, it would have been taken and the border would not exist. At equal ranks the
        leftmost place goes first, so a merge on the left side is taken before one over the border,
        and one over the border before one on the right side.
        """
        order, halves, joined = self.v.order, self.v.halves, self.v.joined
        left, right = a, b
        limit, ties = len(joined), False          # a border merge is taken if below limit, or at it with ties
        while True:
            r = joined.get((left, right))
            if r is not None and (r < limit or ties and r == limit):
                return False
            if order[left] < 0 and order[right] < 0:
                return True
            if order[left] > order[right]:
                limit, ties = order[left], False
                left = halves[left][1]
            else:
                limit, ties = order[right], True
                right = halves[right][0]

    def encodes_itself(self, t: int) -> bool:
        got = self.whole.get(t)
        if got is None:
            h = self.v.halves[t]
            got = self.whole[t] = h is None or self.encodes_itself(h[0]) and self.encodes_itself(h[1]) and self._takes(*h, self.v.order[t])
        return got

    def _takes(self, a: int, b: int, rank: int) -> bool:
        """Whether a and b meet whole before their merge: no earlier border merge between their parts."""
        order, halves, joined = self.v.order, self.v.halves, self.v.joined
        left, right, limit, ties = a, b, rank, False
        while order[left] >= 0 or order[right] >= 0:
            if order[left] > order[right]:
                limit, ties = order[left], False
                left = halves[left][1]
            else:
                limit, ties = order[right], True
                right = halves[right][0]
            r = joined.get((left, right))
            if r is not None and (r < limit or ties and r == limit):
                return False
        return True

    def clear(self) -> None:
        """Forget all prefixes; node 0 is the empty one."""
        self.child: dict[int, int] = {}
        self.last, self.size = [-1], [0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        Prefixes form a trie: a node stores the last token of its prefix and that token's length,
        so prefixes shared by many pre-tokens are solved once.
        """
        child, last, size = self.child, self.last, self.size
        node, way = 0, [0]
        for b in piece:
            node = child.get(node << 8 | b)
            if node is None:
                break
            way.append(node)
        done, n = len(way) - 1, len(piece)
        if done < n:
            fits, whole = self.fits, self.whole
            for b in piece[done:]:
                child[way[-1] << 8 | b] = len(last)
                way.append(len(last))
                last.append(-1)
                size.append(0)
            for end, t in self.automaton.iter(piece.decode("latin-1"), max(0, done - self.longest)):
                if end < done or last[way[end + 1]] >= 0:
                    continue
                start = end + 1 - self.v.length[t]
                if start == 0:
                    good = whole[t] if t in whole else self.encodes_itself(t)
                else:
                    p = last[way[start]]
                    if p < 0:
                        continue
                    good = fits.get(p << 17 | t)
                    if good is None:
                        good = fits[p << 17 | t] = self.encodes_itself(t) and self.compatible(p, t)
                if good:
                    node = way[end + 1]
                    last[node], size[node] = t, end + 1 - start
        out, at = [], n
        while at:
            node = way[at]
            out.append(last[node])
            at -= size[node]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self.v.special[x].to_bytes(4, "little") if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = CHUNKS.split(text)
        head = self.first[chunks[0]]
        return head + b"".join(map(self.later.__getitem__, chunks[1:])) if len(chunks) > 1 else head

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


class Remembered(dict):
    """Ids of chunks, filled on demand; emptied when full."""

    def __init__(self, coder: Coder, prefix: str):
        super().__init__()
        self.coder, self.prefix = coder, prefix

    def __missing__(self, chunk: str) -> bytes:
        c = self.coder
        if len(self) >= REMEMBER:
            self.clear()
        made = b"".join([c.known[p] for p in split_chunk(c.pieces, self.prefix, chunk)])
        if len(chunk) < 256:
            self[chunk] = made
        return made


class Known(dict):
    """Ids of pre-tokens, filled on demand; emptied when full."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        c = self.coder
        made = array.array("I", c.encode_piece(piece.encode())).tobytes()
        if len(self) >= REMEMBER:
            self.clear()
        if len(c.last) > MAX_NODES:
            c.clear()
        if len(c.fits) > MAX_NODES:
            c.fits.clear()
        if len(piece) < 256:
            self[piece] = made
        return made


def _over(docs: DataFrame, path: str, id_col: str, text: str, schema: list[T.StructField], row) -> DataFrame:
    """One pass over (id, text) in Arrow batches; ``row(coder, text)`` gives the further columns."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))       # about 2 MB, fixed by the file
    given = docs.select(docs[f"`{id_col}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    out = T.StructType([T.StructField(id_col, given.schema["k"].dataType), *schema])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.coder()
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 256):                      # a bounded piece of results at a time
                part = b.slice(at, 256)
                made = [row(coder, t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[i] for m in made], kinds[i]) for i in range(len(names)))], [id_col, *names])

    kinds = [pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.string() for f in schema]
    return given.mapInArrow(run, out)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (binary, little-endian unsigned 32-bit integers)."""
    return _over(docs, path, id_col, text, [T.StructField("ids", T.BinaryType())], lambda c, t: (c.encode(t),))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: id, ``n_tokens``, and SHA-256 of the ids and of the decoded text."""
    def row(coder, t):
        ids = coder.encode(t)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()
    return _over(docs, path, id_col, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                                            T.StructField("decoded_sha256", T.StringType())], row)
