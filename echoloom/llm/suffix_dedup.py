"""Exact removal of repeated byte strings, with suffix sorting of shards by external induced sorting.

Every byte covered by a ``MATCH``-byte string that also starts earlier (smaller id, or earlier in the
same text) is removed; strings are judged on the input.

1. Anchors. In each ``MATCH``-byte window the leftmost 32-byte string of smallest hash is its anchor, so
   equal windows have equal anchors wherever they are. Windows side by side with one anchor form a
   segment, about 33 windows long. Segments go to a shard by anchor hash; segments equal byte for byte
   are reduced to the earliest, first within a task, then within the shard. All windows of the
   others are repeats.
2. Different segments with the same anchor are fetched from the texts and split in two: windows that
   hold the anchor and 34 bytes to its left, and the rest, which hold 34 bytes to its right. The 66
   shared bytes are the new key, so frequent short strings do not bring strangers together.
3. Each shard's parts are put together to one byte text and its suffixes are sorted by external
   induced sorting (``suffix_sort``). Runs of suffixes with common prefixes of ``MATCH`` bytes are
   equal windows; all but the earliest of a run are repeats.
4. A key that more than ``CROWD`` different parts share (a frequent line of 66 to 99 bytes) would land in
   one task. Its windows are dealt out one by one instead, by two 64-bit hashes of all their bytes, and
   the earliest of each kind is found by aggregation.
5. Repeats are merged to spans per document and cut out.

A shard is sorted in memory, in pieces of about ``SHARD_BYTES`` that end with a key.
Nothing is capped.

Defined results for odd input: a NULL text is empty. A document without id has no place in the order:
it is returned whole and takes nothing from others. Rows that repeat id and text are one document at one
place and cut alike. Different texts under one id are documents of their own, in the order of a 64-bit
hash of the text, and each is cut by its own spans. Texts under ``MATCH`` bytes are returned whole. Columns beyond the named ones
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import broadcast_if_small, stored
from echoloom.llm.suffix_sort import descending
from echoloom.operators.running import ordinal_by_bucket

MATCH = 100
#: length of an anchor, a power of two
ANCHOR = 32
SPAN = MATCH - ANCHOR + 1
#: context that a part shares beyond the anchor
SIDE = 34
#: texts are scanned together up to this many bytes
STEP_BYTES = 1 << 20
#: anchors of a task that are reduced together before they leave it
HELD_ANCHORS = 1 << 20
#: bytes of parts that are sorted together, if more than one key is there
SHARD_BYTES = 4 << 20
#: a place in a text takes so many bits (Spark's strings are shorter than 2 GB); the number of the text among those of its id stands above
PLACE_BITS = 32
PLACE = (1 << PLACE_BITS) - 1
#: parts with one key beyond which its windows are dealt out one by one
CROWD = 2048


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each position."""
    h, size, p = b.astype(np.uint64), 1, np.array([0x9E3779B97F4A7C15], np.uint64)
    while size < ANCHOR:
        h = h[:-size] * p + h[size:]
        size, p = size * 2, p * p
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, start, windows, anchor offset from start, anchor hash, content hash) of all segments."""
    from xxhash import xxh64_intdigest

    data = b"\n".join([*texts, b""])
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    if len(data) < MATCH + 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    gram = gram_hashes(np.frombuffer(data, np.uint8))
    # smallest hash of each window and its place; of equal ones the leftmost, so that equal windows agree
    least, place, step = gram, np.arange(len(gram), dtype=np.int32), 1
    while step < SPAN:
        hop = min(step, SPAN - step)
        left = least[:-hop] <= least[hop:]
        least, place = np.where(left, least[:-hop], least[hop:]), np.where(left, place[:-hop], place[hop:])
        step += hop
    n = len(least)
    doc = np.repeat(np.arange(len(texts)), size + 1)[:n]
    end = begin + size
    valid = np.arange(n) + MATCH <= end[doc]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(change & valid)
    doc = doc[run]
    count = np.minimum(np.append(run[1:], n), end[doc] - MATCH + 1) - run
    content = np.fromiter((xxh64_intdigest(data[s:e]) for s, e in zip(run.tolist(), (run + count + MATCH - 1).tolist(), strict=True)), np.uint64, len(run))
    return doc, run - begin[doc], count, place[run] - run, least[run].view(np.int64), content.view(np.int64)


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same key, and the same text of it, joined."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    if not len(key):
        return key, start, stop
    base = start >> PLACE_BITS << PLACE_BITS
    new_key = np.ones(len(key), bool)
    new_key[1:] = (key[1:] != key[:-1]) | (base[1:] != base[:-1])
    group = np.cumsum(new_key) - 1
    lift = group * (int((stop - base).max()) + 2) - base     # so that a running maximum does not cross keys
    reach = np.maximum.accumulate(stop + lift) - lift
    new = new_key.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1]


ANCHOR_ROWS = "a long, x long, k long, s long, c int, p int"


def anchors(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (k, o, t) that are first of their kind in their task, and spans of the others.

    A segment is (anchor hash, content hash, id, start, windows, anchor offset); a span has windows -1
    and its end in place of the content hash. Starts and ends carry ``o``, the text's number, above their PLACE_BITS.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reduced(parts):
            a, x, k, s, c, p = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.lexsort((s, k, x, a))
            a, x, k, s, c, p = (v[order] for v in (a, x, k, s, c, p))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (k != k[first]) | (s != s[first])         # a repeated row stands at the same place as its twin
            mk, ms, me = merged(k[again], s[again], s[again] + c[again] + MATCH - 1)
            spread = (mk * 1000003 + ms) * 1000003            # spans only pass through the shuffle: any key will do
            none = np.full(len(mk), -1, np.int32)
            return [(a[new], x[new], k[new], s[new], c[new].astype(np.int32), p[new].astype(np.int32)), (spread, me, mk, ms, none, none)]

        parts, size = [], 0
        for b in batches:
            ids, base, at = b.column(0).to_numpy(), b.column(1).to_numpy() << PLACE_BITS, 0
            column, held, bytes_held = b.column(2), [], 0
            for i in range(b.num_rows + 1):
                t = (column[i].as_py() or "").encode() if i < b.num_rows else b""
                if held and (i == b.num_rows or bytes_held + len(t) > STEP_BYTES):
                    doc, s, c, p, a, x = segments(held)
                    parts.append((a, x, ids[at + doc], base[at + doc] + s, c, p))
                    size += len(a)
                    held, bytes_held, at = [], 0, i
                held.append(t)
                bytes_held += len(t) + 1
            if size > HELD_ANCHORS:
                for cols in reduced(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["a", "x", "k", "s", "c", "p"])
                parts, size = [], 0
        if parts:
            for cols in reduced(parts):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["a", "x", "k", "s", "c", "p"])

    return docs.mapInArrow(run, ANCHOR_ROWS)


def compare_segments(rows: DataFrame) -> DataFrame:
    """From segments and spans: spans of repeats (c = -1, end in x), and segments that have different ones at their anchor."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over rows sorted by (a, x, k, s); between batches it keeps one row: the first of the current content."""
        kept = None                                            # that row, and whether its anchor has been seen before with other content
        for b in batches:
            a, x, k, s, c, p = (col.to_numpy() for col in b.columns)
            spans = c < 0
            out = [tuple(v[spans] for v in (a, x, k, s, c, p))]
            a, x, k, s, c, p = (v[~spans] for v in (a, x, k, s, c, p))
            if not len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out[0]], ["a", "x", "k", "s", "c", "p"])
                continue
            carried = kept is not None
            if carried:
                a, x, k, s, c, p = (np.append(np.array([kept[0][i]], v.dtype), v) for i, v in enumerate((a, x, k, s, c, p)))
            n = len(a)
            new_a, new_x = np.ones(n, bool), np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_x[1:] = new_a[1:] | (x[1:] != x[:-1])
            first = np.flatnonzero(new_x)[np.cumsum(new_x) - 1]
            again = (k != k[first]) | (s != s[first])
            out.append((a[again], (s + c + MATCH - 1)[again].astype(np.int64), k[again], s[again], np.full(again.sum(), -1, np.int32), p[again]))
            firsts = np.flatnonzero(new_x)
            other_before = ~new_a[firsts]
            if carried and kept[1]:
                other_before[0] = True
            other_after = np.append(other_before[1:], False)
            other_after[:-1] &= ~new_a[firsts[1:]]
            told = other_before | other_after
            done = told.copy()
            if carried and kept[1]:
                done[0] = False                                # went out with an earlier batch
            send = firsts[done]
            out.append(tuple(v[send] for v in (a, x, k, s, c, p)))
            last = int(firsts[-1])
            kept = ([v[last] for v in (a, x, k, s, c, p)], bool(told[-1]))
            for cols in out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["a", "x", "k", "s", "c", "p"])

    return rows.repartition("a").sortWithinPartitions("a", "x", "k", "s").mapInArrow(run, ANCHOR_ROWS)


def parts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, k, s, n, bytes): the two halves of each chosen segment, with the text they need and their number of windows."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    wanted = chosen.groupBy("k", F.shiftright("s", PLACE_BITS).alias("o")).agg(
        F.collect_list(F.struct(F.col("s").bitwiseAND(F.lit(PLACE)).alias("s"), "c", "p")).alias("at"))
    given = docs.join(wanted, ["k", "o"]).select("k", "o", "t", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                               pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["key", "k", "s", "n", "bytes"])

        for b in batches:
            rows = []
            for i in range(b.num_rows):
                k, base, t = b.column(0)[i].as_py(), b.column(1)[i].as_py() << PLACE_BITS, (b.column(2)[i].as_py() or "").encode()
                for w in b.column(3)[i].as_py():
                    s, c, q = w["s"], w["c"], w["s"] + w["p"]
                    left = max(0, min(c, w["p"] - SIDE + 1))      # these windows start SIDE bytes or more before the anchor
                    for at, n, lo, hi, side in ((s, left, q - SIDE, q + ANCHOR, 0), (s + left, c - left, q, q + ANCHOR + SIDE, 1)):
                        if n > 0:
                            h = xxh64_intdigest(t[lo:hi], side)
                            rows.append((h - (1 << 64) if h >> 63 else h, k, base + at, n, t[at:at + n + MATCH - 1]))
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    return given.mapInArrow(run, "key long, k long, s long, n int, bytes binary")


def equal_windows(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (k, start, stop) of the windows of ``parts`` (k, s, n, bytes) that are not the earliest of their kind.

    The parts become one text, each followed by a separator below all bytes; its suffixes come sorted
    from ``descending``, and a run of common prefixes of MATCH bytes is one kind of window.
    """
    size = np.array([len(b) + 1 for *_, b in parts])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    text = np.zeros(int(size.sum()) + 1, np.int16)
    raw = np.frombuffer(b"\0".join([*(b for *_, b in parts), b""]), np.uint8)
    text[:-1] = raw
    text[:-1] += 2
    text[begin + size - 1] = 1
    k, s, n = (np.array([q[i] for q in parts], np.int64) for i in range(3))
    part_of = np.repeat(np.arange(len(parts)), size)
    kind, before, found, classes = -1, None, [], []
    for pos, lcp in descending(text):
        same = lcp >= MATCH
        kinds = kind + np.cumsum(~same)
        kind = int(kinds[-1]) if len(kinds) else kind
        near = same.copy()
        near[:-1] |= same[1:]
        if len(same) and same[0] and before is not None:         # the first of a run may stand in the array before
            found.append(before[0])
            classes.append(before[1])
        found.append(pos[near])
        classes.append(kinds[near])
        if len(pos):
            before = None if near[-1] else (pos[-1:], kinds[-1:])
    pos, kinds = np.concatenate(found), np.concatenate(classes)
    part = part_of[pos]
    own = pos - begin[part] < n[part]
    part, kinds, at = part[own], kinds[own], (s[part] + pos - begin[part])[own]
    order = np.lexsort((at, k[part], kinds))
    part, kinds, at = part[order], kinds[order], at[order]
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    again = (k[part] != k[part][first]) | (at != at[first])
    return merged(k[part][again], at[again], at[again] + MATCH)


def compare_windows(parts: DataFrame) -> DataFrame:
    """(k, s, e): spans of repeated windows, from the parts of all keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, key, size = [], [], None, 0

        def spans(rows):
            k, s, e = equal_windows(rows)
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (k, s, e)], ["k", "s", "e"])

        def closed():
            """The finished key's parts, if there are several: with one, no window can repeat."""
            return group if len(group) > 1 else []

        for b in batches:
            for h, k, s, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != key:
                    shard += closed()
                    size = size if shard else 0
                    if size > SHARD_BYTES:
                        yield spans(shard)
                        shard, size = [], 0
                    group, key = [], h
                group.append((k, s, n, t))
                size += len(t) + 1
        shard += closed()
        if shard:
            yield spans(shard)

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "k long, s long, e long")


def crowded_windows(parts: DataFrame) -> DataFrame:
    """(k, s, e): spans of repeated windows among ``parts``, without bringing a key's parts together."""
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows = [(xxh64_intdigest(w, 1), xxh64_intdigest(w, 2), k, s + i)
                        for k, s, n, t in zip(*(c.to_pylist() for c in part.columns), strict=True) for i in range(n) for w in (t[i:i + MATCH],)]
                cols = [np.array(c, np.uint64).view(np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "i", "k", "s"])

    windows = stored(parts.select("k", "s", "n", "bytes").mapInArrow(run, "h long, i long, k long, s long"), "windows")
    first = windows.groupBy("h", "i").agg(F.min(F.struct("k", "s")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    first = stored(first.select("h", "i", F.col("first.k").alias("fk"), F.col("first.s").alias("fs")), "first_windows")
    return windows.join(first, ["h", "i"]).filter("k <> fk OR s <> fs").select("k", "s", (F.col("s") + MATCH).alias("e"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k, s, e) spans of repeats in ``docs`` (k, o, t), with ``o`` above the places; spans of a document may overlap."""
    compared = stored(compare_segments(anchors(docs)), "segments")
    chosen = compared.filter("c > 0").select("k", "s", "c", "p")
    parts = stored(parts_of(docs, chosen), "parts")
    crowds = parts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CROWD)
    crowds = broadcast_if_small(stored(crowds.select("key"), "crowds"))
    more = compare_windows(parts.join(crowds, "key", "left_anti")).unionByName(crowded_windows(parts.join(crowds, "key", "left_semi")))
    return stored(more.unionByName(compared.filter("c < 0").select("k", "s", F.col("x").alias("e"))), "spans")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (k, t, ...) with ``o``: 0, or the number of the text among the different texts of its id.

    Ids and hashes are compared, texts do not move; an id with very many texts is numbered in buckets of the hash.
    """
    h = F.xxhash64(F.coalesce("t", F.lit("")))
    seen = rows.filter("k IS NOT NULL").select("k", h.alias("h"))
    several = stored(seen.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("k"), "ids_with_texts")
    if several.isEmpty():
        return rows.withColumn("o", F.lit(0).cast("long"))
    texts = seen.join(broadcast_if_small(several), "k", "left_semi").distinct()
    number = stored(ordinal_by_bucket(texts, ["k"], ["h"], F.shiftright("h", 48), "o").select(F.col("k").alias("nk"), F.col("h").alias("nh"), "o"), "numbered_texts")
    joined = rows.withColumn("nh", h).join(broadcast_if_small(number).withColumnRenamed("nh", "nh2"), F.col("k").eqNullSafe(F.col("nk")) & (F.col("nh") == F.col("nh2")), "left")
    return joined.select(*rows.columns, F.coalesce("o", F.lit(0)).cast("long").alias("o"))


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """Kept bytes, removed bytes and number of maximal removed runs."""
    if not spans:
        return text, 0, 0
    at = np.array([(w["s"], w["e"]) for w in spans], np.int64).reshape(-1, 2)
    _, start, stop = merged(np.zeros(len(at), np.int64), at[:, 0], np.minimum(at[:, 1], len(text)))
    good = stop > start
    start, stop = start[good], stop[good]
    edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept, len(text) - len(kept), len(start)


def _with_spans(docs: DataFrame, id_col: str, text: str, more: list[str]) -> DataFrame:
    """(k, t, at, m0, m1, ...): rows of ``docs`` with the spans to cut."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("k"), docs[f"`{text}`"].alias("t"), *(docs[f"`{c}`"].alias(f"m{i}") for i, c in enumerate(more)))
    rows = numbered(rows)
    spans = repeated_spans(rows.filter("k IS NOT NULL").select("k", "o", "t"))
    local = F.struct(*(F.col(c).bitwiseAND(F.lit(PLACE)).alias(c) for c in ("s", "e")))
    return rows.join(spans.groupBy("k", F.shiftright("s", PLACE_BITS).alias("o")).agg(F.collect_list(local).alias("at")), ["k", "o"], "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                t = (b.column(1)[i].as_py() or "").encode()
                kept, removed, n = _cut(t, b.column(2)[i].as_py())
                rows.append((len(t), removed, n, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    given = _with_spans(docs, id_col, text, []).select("k", "t", "at")
    return given.mapInArrow(run, T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                                               T.StructField("kept_sha256", T.StringType())]))


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeats cut out of ``text``. Bytes of a character that was cut in the middle are dropped with it."""
    import pyarrow as pa

    more = [c for c in docs.columns if c not in (id_col, text)]
    given = _with_spans(docs, id_col, text, more)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType()), *(given.schema[f"m{i}"] for i in range(len(more)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, at in enumerate(b.column(2).to_pylist()):
                if at:
                    texts[i] = _cut((texts[i] or "").encode(), at)[0].decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *b.columns[3:]], schema.names)

    done = given.select("k", "t", "at", *(f"m{i}" for i in range(len(more)))).mapInArrow(run, schema)
    back = {id_col: "k", text: "t"} | {c: f"m{i}" for i, c in enumerate(more)}
    return done.select(*(F.col(back[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
