"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Layout. Vectors become whole numbers. Rows are range-sorted by label and position on a Hilbert curve and cut into
blocks, one Parquet row each: packed ids, labels and vectors, and the zone map (lowest and highest label and value
of every dimension). Zone maps are read without the vectors.

Search. An anchor has windows of scores and wants the best k rows of each. For a block, interval arithmetic on the zone
map gives the lowest and highest score that any of its rows can have with the anchor; the block is read for the anchor
only if that range meets one of its windows and its labels can matter. Anchors are packed by block and gathered into
chunks; blocks are dealt into shards. A tile is one chunk and one shard: it holds the anchors, takes one block at a
time, and keeps the k best of each window, so its windows narrow as it goes. A first round takes about the root of
the number of shards; the k-th best found there is where the windows begin in the second round, which has the other
shards. So tiles return few rows, and a block that cannot reach into any window of a chunk is not moved to it.

Mining. First the window (k-th best row of the own block, no end) among equal labels: an anchor's positives. Then, per
positive score p, the window [ceil(low * p), floor(high * p)] among other labels: its negatives. All scores are exact,
every row is in the index, and no window is cut short: results equal a search of all rows.

All sizes are bounded: a block by BLOCK rows, a chunk by CHUNK anchors and one block's more, a shard by SHARD blocks. Copies of
a vector, or a hot label, fill more blocks and not larger ones.

Defined results for odd input: rows whose label or vector is NULL, or whose vector holds a NULL or non-finite entry, take
no part. Shorter vectors are filled up with zeros. A row with a NULL id is no anchor and comes last among equal scores.
Ties go to the smaller id. Repeated rows are rows of their own, as anchors too; an anchor is not its own positive, a
copy of it is. Positive scores below zero have no window. Scores beyond a long are held at its ends. Columns
beyond the named ones are ignored. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import broadcast_if_small, stored
from echoloom.llm.hilbert import positions
from echoloom.llm.whitening import matrix, whole_vectors
from echoloom.operators.running import running

POSITIVES = 5
NEGATIVES = 10
#: percent of the positive's score at which the window of negatives begins and ends
LOW, HIGH = 30, 90
#: rows of a block
BLOCK = 512
#: blocks in one range of the sort
RANGE_BLOCKS = 16
#: blocks of a shard
SHARD = 256
#: anchors of a chunk
CHUNK = 32_768
#: zone maps that are met by a chunk in one task
ZONES = 1024
#: bits a dimension on the curve
BITS = 4
#: anchors scored against a block at once
SLICE = 1024
END = 1 << 62
#: stands for a NULL id, after all others
NO_ID = (1 << 63) - 1

BLOCKS = ("part int, seq int, n int, anchors int, label_lo long, label_hi long, low array<long>, high array<long>, "
          "ids binary, labels binary, flags binary, x binary")
ANCHORS = "part int, seq int, m int, ids binary, labels binary, pos binary, x binary, lo binary, up binary"
FOUND = "part int, seq int, pos int, w int, anchor long, score long, id long"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, its width first."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack(b: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).reshape(-1, dims).astype(np.int64)


def longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8")


def biggest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores of all rows of ``a`` with all rows of ``b``: as doubles where these are exact, else as longs."""
    most = biggest(a) * biggest(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return a.astype(float) @ b.astype(float).T
    if most < 1 << 63:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -NO_ID, NO_ID).astype(np.int64)


class Anchors:
    """Packed anchors of a chunk with their windows [lo, up] and the k best rows of each window so far."""

    def __init__(self, rows: list[dict], dims: int, k: int, same: bool):
        self.k, self.same, self.dims = k, same, dims
        self.part = np.concatenate([np.full(r["m"], r["part"], np.int32) for r in rows])
        self.seq = np.concatenate([np.full(r["m"], r["seq"], np.int32) for r in rows])
        self.pos = np.concatenate([np.frombuffer(r["pos"], "<i4") for r in rows])
        self.ids, self.labels = (np.concatenate([longs(r[c]) for r in rows]) for c in ("ids", "labels"))
        self.x = np.concatenate([unpack(r["x"], dims) for r in rows])
        n = len(self.ids)
        self.lo, self.up = (np.concatenate([longs(r[c]).reshape(r["m"], -1) for r in rows]) for c in ("lo", "up"))
        self.lo = self.lo.copy()
        self.windows = self.lo.shape[1]
        # best[i, w] = the k best as (score, id), best first; `count` of them are there
        self.score, self.id = np.zeros((n * self.windows, k), np.int64), np.full((n * self.windows, k), NO_ID)
        self.count = np.zeros(n * self.windows, np.int64)
        self.plus, self.minus = np.maximum(self.x, 0).astype(float), np.minimum(self.x, 0).astype(float)

    def wanting(self, zone: dict) -> np.ndarray:
        """Indexes of the anchors that have to read the block of this zone map."""
        low, high = np.array(zone["low"], float), np.array(zone["high"], float)
        most, least = self.plus @ high + self.minus @ low, self.plus @ low + self.minus @ high
        size = (self.plus - self.minus) @ np.maximum(np.abs(low), np.abs(high))
        slack = np.where(size < 2.0 ** 53, 0.0, size * 2.0 ** -40)           # sums below 2^53 are exact
        meets = ((most + slack)[:, None] >= self.lo) & ((least - slack)[:, None] <= self.up) & (self.lo <= self.up)
        if self.same:
            labels = (zone["label_lo"] <= self.labels) & (self.labels <= zone["label_hi"])
        else:
            labels = (zone["label_lo"] != self.labels) | (zone["label_hi"] != self.labels)
        return np.flatnonzero(labels & meets.any(1))

    def read(self, block: dict) -> None:
        """Meet the rows of a block."""
        wanting = self.wanting(block)
        if len(wanting):
            x, ids, labels = unpack(block["x"], self.dims), longs(block["ids"]), longs(block["labels"])
            for i in range(0, len(wanting), SLICE):
                self._meet(wanting[i:i + SLICE], x, ids, labels, (block["part"], block["seq"]))

    def _meet(self, some: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, block: tuple[int, int]) -> None:
        s, k = inner_products(self.x[some], x), self.k
        fits = (self.labels[some][:, None] == labels[None, :]) == self.same
        own = np.flatnonzero((self.part[some] == block[0]) & (self.seq[some] == block[1]))
        fits[own, self.pos[some][own]] = False
        groups, scores, found = [], [], []
        for w in range(self.windows):
            inside = fits & (s >= self.lo[some, w][:, None]) & (s <= self.up[some, w][:, None])
            many = np.flatnonzero(inside.sum(1) > k)
            if len(many):
                ranked = np.where(inside[many], s[many], s.dtype.type(-NO_ID))
                kth = np.partition(ranked, -k, axis=1)[:, -k]
                inside[many] &= s[many] >= kth[:, None]                          # rows equal to the k-th stay
            r, c = np.nonzero(inside)
            groups.append(some[r] * self.windows + w)
            scores.append(s[r, c].astype(np.int64))
            found.append(ids[c])
        self._keep(np.concatenate(groups), np.concatenate(scores), np.concatenate(found))

    def _keep(self, group: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        there = np.arange(self.k)[None, :] < self.count[touched][:, None]
        group = np.concatenate([np.repeat(touched, self.count[touched]), group])
        score = np.concatenate([self.score[touched][there], score])
        found = np.concatenate([self.id[touched][there], found])
        order = np.lexsort((found, -score, group))
        group, score, found = group[order], score[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = rank < self.k
        group, rank = group[keep], rank[keep]
        self.score[group, rank], self.id[group, rank] = score[keep], found[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, group), minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        at, w = full // self.windows, full % self.windows
        self.lo[at, w] = np.maximum(self.lo[at, w], self.score[full, self.k - 1])

    def found(self) -> list[np.ndarray]:
        """Columns of FOUND."""
        group, rank = np.nonzero(np.arange(self.k)[None, :] < self.count[:, None])
        at = group // self.windows
        return [self.part[at], self.seq[at], self.pos[at], (group % self.windows).astype(np.int32), self.ids[at], self.score[group, rank], self.id[group, rank]]


def vectors(df: DataFrame, id_col: str, label: str, vector: str, anchor: Column) -> DataFrame:
    """(id, label, anchor, x) of the rows that take part."""
    key, vec = df[f"`{id_col}`"], df[f"`{vector}`"]
    rows = df.select(F.struct(F.coalesce(key.cast("long"), F.lit(NO_ID)).alias("id"), df[f"`{label}`"].cast("long").alias("label"),
                              (F.coalesce(anchor, F.lit(False)) & key.isNotNull()).alias("anchor")).alias("who"), vec.alias("vec"))
    return whole_vectors(rows.filter("who.label IS NOT NULL"), "who", "vec").select("k.*", "x")


def build_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of ``rows`` in Hilbert order within labels, stored, and the number of dimensions."""
    import pyarrow as pa

    rows = stored(rows, "vectors")
    ends = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"), F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not ends["d"]:                                                              # only empty vectors: one entry, zero
        rows = rows.withColumn("x", F.array(F.lit(0).cast("long")))
    dims, lo = ends["d"] or 1, float(ends["lo"] or 0)
    span, block = float(ends["hi"] or 0) - lo + 1, BLOCK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.clip((matrix(b.column(3)) - lo) / span * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(positions(cells, BITS), pa.binary())], [*b.schema.names, "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= block:
                yield one(held.slice(0, block), part, seq)
                held, seq = held.slice(block), seq + 1
        if held is not None and held.num_rows:
            yield one(held, part, seq)

    def one(t: pa.Table, part: int, seq: int) -> pa.RecordBatch:
        t = t.combine_chunks()
        x = matrix(t.column("x").chunk(0))
        labels, flags = t.column("label").to_numpy(), t.column("anchor").to_numpy()
        return pa.RecordBatch.from_pylist([{
            "part": part, "seq": seq, "n": len(x), "anchors": int(flags.sum()), "label_lo": int(labels.min()), "label_hi": int(labels.max()),
            "low": x.min(0).tolist(), "high": x.max(0).tolist(), "ids": t.column("id").to_numpy().astype("<i8").tobytes(),
            "labels": labels.astype("<i8").tobytes(), "flags": flags.astype(bool).tobytes(), "x": pack(x)}], shape)

    shape = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("anchors", pa.int32()), ("label_lo", pa.int64()), ("label_hi", pa.int64()),
                       ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("ids", pa.binary()), ("labels", pa.binary()), ("flags", pa.binary()), ("x", pa.binary())])
    placed = rows.select("id", "label", "anchor", "x").mapInArrow(place, "id long, label long, anchor boolean, x array<long>, h binary")
    ranges = max(1, -(-ends["n"] // (block * RANGE_BLOCKS)))
    ordered = placed.repartitionByRange(ranges, "label", "h", "id").sortWithinPartitions("label", "h", "id")
    return stored(ordered.select("id", "label", "anchor", "x").mapInArrow(cut, BLOCKS), "blocks"), dims


def _pack_anchors(rows: list[dict], pa) -> object:
    kinds = {"part": pa.int32(), "seq": pa.int32(), "m": pa.int32()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.binary())) for c in ("part", "seq", "m", "ids", "labels", "pos", "x", "lo", "up")]))


def anchors_of(blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """Packed anchors of each block that has some, with the window from the k-th best row of equal label in the block."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(block["flags"], bool))
                row = {"part": block["part"], "seq": block["seq"], "m": len(at), "ids": longs(block["ids"])[at].tobytes(),
                       "labels": longs(block["labels"])[at].tobytes(), "pos": at.astype("<i4").tobytes(), "x": pack(unpack(block["x"], dims)[at]),
                       "lo": np.full(len(at), -END).tobytes(), "up": np.full(len(at), NO_ID).tobytes()}
                home = Anchors([row], dims, k, same=True)
                home.read(block)
                yield _pack_anchors([row | {"lo": home.lo.tobytes()}], pa)

    return stored(blocks.filter("anchors > 0").mapInArrow(run, ANCHORS), "anchors")


def chunked(blocks: DataFrame) -> DataFrame:
    """(part, seq, chunk) of the blocks with anchors: neighbours in the order share a chunk."""
    own = blocks.filter("anchors > 0").select("part", "seq", "anchors")
    own = running(own, [], ["part", "seq"], F.floor(F.col("part") / 64), {"before": ("sum", F.col("anchors"), False)})
    return own.select("part", "seq", F.floor(F.col("before") / CHUNK).cast("long").alias("chunk"))


def with_windows(anchors: DataFrame, scores: DataFrame, change) -> DataFrame:
    """``anchors`` with new windows: ``change(lo, up, entries)`` gets the arrays (anchor, window) of a block and the entries
    (index, w, score) of ``scores`` (part, seq, pos, w, score) that belong to it, and returns new arrays."""
    import pyarrow as pa

    per = scores.groupBy("part", "seq").agg(F.collect_list(F.struct("pos", "w", "score")).alias("entries"))   # bounded by the block
    joined = anchors.join(per, ["part", "seq"], "left").select(*anchors.columns, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                entries = r.pop("entries") or []
                at = np.searchsorted(np.frombuffer(r["pos"], "<i4"), [e["pos"] for e in entries]).astype(np.int64)
                lo, up = (longs(r[c]).reshape(r["m"], -1).copy() for c in ("lo", "up"))
                lo, up = change(lo, up, (at, np.array([e["w"] for e in entries], np.int64), np.array([e["score"] for e in entries], np.int64)))
                out.append({c: r[c] for c in ("part", "seq", "m", "ids", "labels", "pos", "x")} | {"lo": lo.tobytes(), "up": up.tobytes()})
            yield _pack_anchors(out, pa)

    return stored(joined.mapInArrow(run, ANCHORS), "windows")


def _raised(lo: np.ndarray, up: np.ndarray, entries: tuple) -> tuple[np.ndarray, np.ndarray]:
    at, w, score = entries
    np.maximum.at(lo, (at, w), score)
    return lo, up


def _around(low: int, high: int, most: int):
    """Windows below the scores of the positives, numbered by rank; a missing positive has an empty one."""
    def change(lo: np.ndarray, up: np.ndarray, entries: tuple) -> tuple[np.ndarray, np.ndarray]:
        at, w, score = entries
        lo, up = np.ones((len(lo), most), np.int64), np.zeros((len(up), most), np.int64)
        exact = score.astype(object)
        lo[at, w], up[at, w] = (-((-low * exact) // 100)).astype(np.int64), ((high * exact) // 100).astype(np.int64)
        return lo, up
    return change


def _tiles(anchors: DataFrame, others: DataFrame, tasks: int, work, schema: str) -> DataFrame:
    """Anchors and blocks (or zone maps) that share (chunk, shard) in one task, the anchors first."""
    names = ["m", "ids", "labels", "pos", "x", "lo", "up", "label_lo", "label_hi", "low", "high"]

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        types = dict(anchors.dtypes) | dict(others.dtypes)
        return df.select("chunk", "shard", F.lit(kind).alias("kind"), "part", "seq",
                         *(F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "binary")).alias(c) for c in names))

    both = shaped(anchors, 0).unionByName(shaped(others, 1))
    return both.repartition(tasks, "chunk", "shard").sortWithinPartitions("chunk", "shard", "kind", "part", "seq").mapInArrow(work, schema)


def _choose(k: int, same: bool, dims: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, held = None, [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if tile != (r["chunk"], r["shard"]):
                    tile, rows, held = (r["chunk"], r["shard"]), [], None
                if r["kind"] == 0:
                    rows.append(r)
                elif rows:
                    held = held or Anchors(rows, dims, k, same)
                    wanted = len(held.wanting(r))
                    if wanted:
                        out.append({"chunk": r["chunk"], "part": r["part"], "seq": r["seq"], "wanted": wanted})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("wanted", pa.int64())]))
    return run


def _score(k: int, same: bool, dims: int):
    import pyarrow as pa

    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, held = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if tile != (r["chunk"], r["shard"]):
                    if held is not None:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held.found())), names)
                    tile, rows, held = (r["chunk"], r["shard"]), [], None
                if r["kind"] == 0:
                    rows.append(r)
                elif rows:
                    held = held or Anchors(rows, dims, k, same)
                    held.read(r)
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held.found())), names)
    return run


def needed(anchors: DataFrame, zones: DataFrame, chunks: int, k: int, same: bool, dims: int) -> DataFrame:
    """(chunk, part, seq, wanted): blocks that ``wanted`` anchors of a chunk have to read, from zone maps alone."""
    shards = max(1, -(-zones.count() // ZONES))
    zones = (zones.select("part", "seq", "label_lo", "label_hi", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")).alias("chunk"))
             .withColumn("shard", F.pmod(F.xxhash64("part", "seq"), F.lit(shards))))
    spread = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    return stored(_tiles(spread, zones, chunks * shards, _choose(k, same, dims), "chunk long, part int, seq int, wanted long"), "needed")


def search(anchors: DataFrame, blocks: DataFrame, chunk_of: DataFrame, chunks: int, k: int, same: bool, dims: int) -> DataFrame:
    """The ``k`` best rows of every window: FOUND with ``rank`` from 1. ``same``: of the anchor's label, else of other labels."""
    spark, n = blocks.sparkSession, blocks.count()
    shards = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD)))
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("part", "seq"), F.lit(shards)))
    first = math.isqrt(shards - 1) + 1
    best, order = None, Window.partitionBy("part", "seq", "pos", "w").orderBy(F.col("score").desc(), "id")
    for lo, hi in ((0, first), (first, shards)):
        if lo == hi:
            continue
        if best is not None:
            anchors = with_windows(anchors, best.filter(F.col("rank") == k), _raised)
        placed = anchors.join(chunk_of, ["part", "seq"]).select("chunk", *anchors.columns)
        some = dealt.filter(F.col("shard").between(lo, hi - 1))
        reads = broadcast_if_small(needed(placed, some, chunks, k, same, dims))
        moved = some.join(reads, ["part", "seq"]).drop("wanted")
        spread = placed.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)).cast("array<long>")))
        tiles = _tiles(spread, moved, chunks * (hi - lo), _score(k, same, dims), FOUND)
        if best is not None:
            tiles = tiles.unionByName(best.drop("rank"))
        best = stored(tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
    return best


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of each positive of each row for which ``anchor`` holds: anchor_id, positive_id, rank, negative_id, scores.

    ``low`` and ``high`` are percents of the positive's score.
    """
    blocks, dims = build_blocks(vectors(df, id_col, label, vector, anchor))
    total = blocks.agg(F.sum("anchors")).first()[0] or 0
    final = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return df.sparkSession.createDataFrame([], final)
    chunk_of, chunks = stored(chunked(blocks), "chunks"), total // CHUNK + 1
    anchors = anchors_of(blocks, dims, positives)
    near = search(anchors, blocks, chunk_of, chunks, positives, True, dims)
    near = near.select("part", "seq", "pos", (F.col("rank") - 1).alias("w"), F.col("id").alias("near_id"), F.col("score").alias("near_score"))
    below = with_windows(anchors, near.withColumnRenamed("near_score", "score"), _around(low, high, positives))
    hard = search(below, blocks, chunk_of, chunks, negatives, False, dims)
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return hard.join(near, ["part", "seq", "pos", "w"]).select(
        F.col("anchor").alias("anchor_id"), named("near_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"),
        F.col("near_score").alias("positive_score"), F.col("score").alias("negative_score"))
