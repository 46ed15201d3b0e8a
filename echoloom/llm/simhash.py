"""SimHash near-duplicates, with pivot distance tables in front of the exact comparison.

Fingerprints: a bit is 1 if it is set in over half of the hashes of all four-word shingles. Two
fingerprints link at 4 or fewer differing bits, and documents are grouped by what they can reach.

Finding the links. Equal fingerprints collapse first. A fingerprint is cut into bands; two that
differ in 4 bits at most agree on all but 4 bands, so each set of the other bands is a block key
and every linked pair meets in some block. Inside a block the Hamming distances to many reference
fingerprints are computed once per member. By the triangle inequality linked members differ by 4 at
most in each of these coordinates; pairs whose largest coordinate difference is above 4 are
discarded, and the survivors are compared bit by bit. A block returns a spanning star for each of
its linked sets, so output is linear in members. A block with more than ``BLOCK`` members is dealt
into cells, and each pair of cells becomes a task of its own: all pairs are still compared.

Defined results for odd input: a NULL or blank text has fingerprint zero and is linked like any
other. A document with a NULL id gets the component of its fingerprint, named by the smallest id
that is not NULL (NULL if there is none). Repeated rows come back each. Columns beyond the named
ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import broadcast_if_small, fresh, stored
from echoloom.llm.components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: reference fingerprints of the pivot tables
PIVOTS = 16
#: members of a block, or of a cell of a large block
BLOCK = 1024


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()          # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = [s - 1 for s in starts[min(SHINGLE, len(words)):]]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=False)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, fp) per row: the id, a hash of the text and the fingerprint as a signed long."""
    import pyarrow as pa

    given = docs.select(docs[f"`{id_col}`"].alias("k"), _text_hash(docs, text).alias("h"), docs[f"`{text}`"].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made.view(np.int64))], ["k", "h", "fp"])

    return given.mapInArrow(run, T.StructType([T.StructField("k", given.schema["k"].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())]))


def _text_hash(docs: DataFrame, text: str) -> Column:
    return F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))


def band_masks(bands: int) -> list[int]:
    """Masks of all sets of ``bands - 4`` of ``bands`` equal bands, as signed longs."""
    edges = [64 * i // bands for i in range(bands + 1)]
    single = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(single, bands - MAX_BITS))]


def bands_for(n: int) -> int:
    """More and longer keys for more fingerprints, so that chance meetings stay rare; the links found are the same."""
    return 6 if n < 1 << 21 else 7 if n < 1 << 27 else 8


def pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, PIVOTS, np.uint64)


def block_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) of the linked sets inside each run of equal ``keys``."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    label, n = np.arange(len(fps)), len(fps)
    at, step, left, right = np.arange(n), 0, [], []
    while True:
        step += 1
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 16):
            i = at[lo:lo + (1 << 16)]
            near = np.abs(table[i] - table[i + step]).max(axis=1) <= MAX_BITS
            i = i[near]
            i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= MAX_BITS]
            left.append(i)
            right.append(i + step)
    if not left:
        return fps[:0], fps[:0]
    left, right = np.concatenate(left), np.concatenate(right)
    while len(left):
        least = np.minimum(label[left], label[right])
        grown = label.copy()
        np.minimum.at(grown, left, least)
        np.minimum.at(grown, right, least)
        np.minimum.at(grown, label[left], least)
        np.minimum.at(grown, label[right], least)
        grown = grown[grown]
        if (grown == label).all():
            break
        label = grown
    own = np.flatnonzero(label != np.arange(n))
    return fps[own], fps[label[own]]


def links(unique: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` that span the same sets as all links do."""
    import pyarrow as pa

    masks = band_masks(bands_for(unique.count()))
    keyed = unique.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))).alias("key"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = broadcast_if_small(stored(large.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("cells")), "large_blocks"))
    cell = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cells"))
    other = F.explode(F.when(F.col("cells").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = keyed.join(large, "key", "left").select("fp", "key", cell.alias("c"), other.alias("o"))
    unit = F.when(F.col("c").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")))
    units = dealt.select(unit.alias("unit"), "fp").repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.array([], np.int64), np.array([], np.uint64)

        def done(k, f):
            a, b = block_links(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0         # the last unit may go on in the next batch
            if cut:
                yield done(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        if len(held_k):
            yield done(held_k, held_f)

    return units.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h, fp, head) per row of ``docs``; ``head`` is the component's smallest (id, text hash), NULL if no row of it has an id."""
    own = stored(fingerprints(docs, id_col, text), "fingerprints")
    unique = stored(own.groupBy("fp").agg(F.min(F.when(F.col("k").isNotNull(), F.struct("k", "h"))).alias("first")), "unique")
    roots = components(links(unique.select("fp")))
    member = stored(unique.join(roots, unique.fp == roots.node).select("fp", "first", "root"), "linked")
    named = stored(member.groupBy("root").agg(F.min("first").alias("head")), "named")
    linked = member.join(named, "root").select("fp", "head")
    rest = unique.join(member.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("head"))
    return own.join(stored(linked.unionByName(rest), "components"), "fp").select("k", "h", "fp", "head")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    return grouped(docs, id_col, text).select(
        F.col("k").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head.k").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text name their component.

    Different texts under one id are documents of their own. Of rows that repeat id and text, the one with the
    smallest hash of all its columns stays. Rows without an id cannot stand for a group: they stay.
    """
    named, unnamed = docs.filter(docs[f"`{id_col}`"].isNotNull()), docs.filter(docs[f"`{id_col}`"].isNull())
    rows = grouped(named, id_col, text).groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k").eqNullSafe(F.col("head.k")) & F.col("h").eqNullSafe(F.col("head.h"))).alias("names"))
    # what goes, and what repeats, is much less than what stays: texts are not moved to find it
    key, own, n, names = (fresh(docs, c) for c in ("seen_key", "seen_hash", "seen_rows", "names_group"))
    odd = stored(rows.filter("n > 1 OR NOT names"), "odd").withColumnsRenamed({"k": key, "h": own, "n": n, "names": names})
    marked = named.join(broadcast_if_small(odd), (named[f"`{id_col}`"] == odd[key]) & (_text_hash(named, text) == odd[own]), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*(F.coalesce(c.cast("string"), F.lit("\0")) for c in columns))
    again = marked.filter(F.col(names)).groupBy(key, own).agg(F.min_by(F.struct(*columns), row).alias("row")).select("row.*")
    return marked.filter(F.col(key).isNull()).select(*columns).unionByName(again).unionByName(unnamed)
