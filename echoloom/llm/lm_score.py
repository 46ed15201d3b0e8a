"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every token is predicted from its neighbours on both sides; a document's score is the sum of the
conditional log-probabilities of its tokens.

What the network learns from covers the whole corpus. All words are counted, and the counts stay a
Spark table. A word that makes up ``1 / sqrt(tokens)`` of the corpus or more, and the ``FREQUENT`` most
frequent ones in any case, have a class each; their number grows with the corpus. All others share
hashed classes, and their probability is that of the class times their share of its occurrences, so
a word's score is always its own. An unseen word counts as one occurrence more of its class; with it
the shares of a class add up to one.

All documents are counted by (left class, class, right class). The counts stay a Spark table too,
in parts of about ``PART_TOKENS`` tokens: a step of training adds up the gradients of one part's
partitions, and every part is used ``PASSES`` times at least. A small table is fitted on the driver.
Shares are looked up by a join with the word counts; words with a class of their own, which would be
the hot keys, take no part in it.

Defined results for odd input: a NULL or blank text has no tokens and score zero (mean NULL).
Repeated rows count and are scored each. Columns beyond the named ones are ignored. From an empty
table an empty result comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import stored
from echoloom.llm.tokenscan import Scan, steps
from echoloom.session import scratch_path

#: classes at least: 0 is the border of a text, then FREQUENT words, then hashed classes
CLASSES = 128
FREQUENT = 95
SHARED = CLASSES - 1 - FREQUENT
WIDTH = 16
STEPS = 80
PASSES = 4
RATE = 0.05
SEED = 7
#: tokens behind one step of training
PART_TOKENS = 16_000_000
#: a table of so many triples is fitted on the driver
LOCAL_TRIPLES = 1 << 20
#: so many normalisers of pairs are sent to the workers (16 MB); with more pairs they are worked out as they come
NORMS = 1 << 22


def _arrow_rows(docs: DataFrame, text: str, run, schema: str) -> DataFrame:
    return docs.select(docs[f"`{text}`"].alias("t")).mapInArrow(run, schema)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): hash of each word of the corpus and how often it occurs."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(inverse, np.concatenate([n for _, n in held]), len(h)).astype(np.int64)

        size = 0
        for b in batches:
            for _, texts in steps(b.column(0)):
                held.append(np.unique(Scan(texts).hash, return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:                                 # what is held stays small; the shuffle adds up the rest
                    h, n = merged()
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])
                    held, size = [], 0
        if held:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return _arrow_rows(docs, text, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame) -> tuple[np.ndarray, int]:
    """(sorted hashes of the words with a class of their own, tokens of the corpus), from the word counts."""
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = words.filter(F.col("n") >= max(1, tokens) ** 0.5).select("word").toArrow()["word"].to_numpy()
    if len(top) < FREQUENT:
        top = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    return np.sort(np.array(top, np.int64).view(np.uint64)), tokens


def n_classes(known: np.ndarray) -> int:
    return 1 + max(FREQUENT, len(known)) + SHARED


def classes(scan: Scan, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, own, right) class of each token; a neighbour beyond the text is class 0."""
    own = (np.uint64(n_classes(known) - SHARED) + scan.hash % np.uint64(SHARED)).astype(np.int64)
    if len(known):
        at = np.searchsorted(known, scan.hash).clip(max=len(known) - 1)
        own = np.where(known[at] == scan.hash, 1 + at, own)
    left, right = np.zeros_like(own), np.zeros_like(own)
    inner = scan.doc[1:] == scan.doc[:-1]
    left[1:][inner] = own[:-1][inner]
    right[:-1][inner] = own[1:][inner]
    return left, own, right


def triple_counts(docs: DataFrame, known: np.ndarray, text: str = "text") -> DataFrame:
    """(pair, own, n): occurrences of each (left, own, right) in the corpus, pair = left * C + right; a pair is in one partition."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(known)
    c = n_classes(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(cell), 1 << 16):
                part = cell[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part // c), pa.array((part % c).astype(np.int32)), pa.array(n[at:at + (1 << 16)])], ["pair", "own", "n"])

        for b in batches:
            for _, texts in steps(b.column(0)):
                left, own, right = classes(Scan(texts), shared.value)
                held.append((left * c + right) * c + own)
                size += len(own)
                if size > 1 << 22:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return _arrow_rows(docs, text, run, "pair long, own int, n long").repartition("pair").groupBy("pair", "own").agg(F.sum("n").alias("n"))


class WindowNetwork:
    """Embeddings of the left and right neighbour, added and squashed, then a softmax over classes."""

    #: (word, n) of the corpus, and what the log-probability of a class's word has besides that of the class and ln n
    words: DataFrame | None = None
    inside: np.ndarray | None = None

    def __init__(self, size: int = CLASSES):
        self.size = size
        rng = np.random.default_rng(SEED)
        shape = {"left": (size, WIDTH), "right": (size, WIDTH), "inner": (WIDTH,), "out": (WIDTH, size), "bias": (size,)}
        self.p = {k: (rng.normal(0, 0.3, s) if k in ("left", "right", "out") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))

    @staticmethod
    def hidden(p: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(p["left"][left] + p["right"][right] + p["inner"])

    @staticmethod
    def norms(p: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Log of the softmax's denominator for each pair of neighbours."""
        out, step = np.zeros(len(left), np.float32), max(1, (1 << 20) // len(p["bias"]))
        for lo in range(0, len(left), step):
            z = WindowNetwork.hidden(p, left[lo:lo + step], right[lo:lo + step]) @ p["out"] + p["bias"]
            top = z.max(axis=1)
            out[lo:lo + step] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out

    @staticmethod
    def gradient(p: dict, pair: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[float, dict]:
        """(loss, gradients), summed over occurrences; rows of a pair stand together."""
        size = len(p["bias"])
        g, loss = {k: np.zeros(x.shape) for k, x in p.items()}, 0.0
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        ends = np.append(first, len(pair))
        step = max(1, (1 << 19) // size)                                  # a block of log-probabilities stays in cache
        for lo in range(0, len(first), step):
            a, b = ends[lo], ends[min(lo + step, len(first))]
            start = first[lo:lo + step]
            left, right = pair[start] // size, pair[start] % size
            row = np.repeat(np.arange(len(start)), np.diff(ends[lo:lo + len(start) + 1]))
            hidden = WindowNetwork.hidden(p, left, right)
            z = hidden @ p["out"]
            z += p["bias"]
            z -= z.max(axis=1, keepdims=True)
            at, w = own[a:b], n[a:b].astype(np.float32)
            picked = z[row, at]
            np.exp(z, out=z)
            total = z.sum(axis=1, keepdims=True)
            loss -= float((w * (picked - np.log(total[row, 0]))).sum())
            z *= np.bincount(row, w, len(start)).astype(np.float32)[:, None] / total
            np.subtract.at(z, (row, at), w)
            dh = (z @ p["out"].T) * (1 - hidden ** 2)
            g["out"] += hidden.T @ z
            g["bias"] += z.sum(axis=0)
            np.add.at(g["left"], left, dh)
            np.add.at(g["right"], right, dh)
            g["inner"] += dh.sum(axis=0)
        return loss, g

    def step(self, number: int, g: dict, rate: float = RATE) -> None:
        """One Adam step along mean gradients."""
        for k, x in g.items():
            x = x.astype(np.float32)
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            self.p[k] = self.p[k] - np.float32(rate) * (self.m[k] / (1 - 0.9 ** number)) / (np.sqrt(self.v[k] / (1 - 0.999 ** number)) + np.float32(1e-8))

    def start(self, marginal: np.ndarray) -> None:
        self.p["bias"] = np.log(marginal / max(marginal.sum(), 1) + 1e-9).astype(np.float32)

    def fit(self, counts: np.ndarray, steps: int = STEPS) -> list[float]:
        """Full-batch steps on dense counts (left, right, own); returns the mean loss before each step."""
        cell = np.flatnonzero(counts)
        return self.fit_rows(cell // self.size, cell % self.size, counts[cell], steps)

    def fit_rows(self, pair: np.ndarray, own: np.ndarray, n: np.ndarray, steps: int = STEPS) -> list[float]:
        """The same on sparse counts sorted by pair."""
        self.start(np.bincount(own, n, self.size))
        total, losses = max(n.sum(), 1), []
        for number in range(1, steps + 1):
            loss, g = self.gradient(self.p, pair, own, n)
            losses.append(loss / total)
            self.step(number, {k: x / total for k, x in g.items()})
        return losses

    def fit_parts(self, triples: DataFrame, parts: int) -> list[float]:
        """Steps on one part (column ``part``) after the other; each adds up the gradients of the part's partitions."""
        import pyarrow as pa

        spark, losses = triples.sparkSession, []
        total = max(STEPS, PASSES * parts)
        for number in range(1, total + 1):
            shared = spark.sparkContext.broadcast(self.p)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                loss, n, g = 0.0, 0, None
                for b in batches:
                    if b.num_rows:
                        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                        more, d = WindowNetwork.gradient(shared.value, *cols)
                        loss, n, g = loss + more, n + int(cols[2].sum()), d if g is None else {k: g[k] + x for k, x in d.items()}
                if g:
                    flat = np.concatenate([g[k].ravel() for k in sorted(g)])
                    yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], ["loss", "n", "g"])

            rows = triples.filter(F.col("part") == (number - 1) % parts).select("pair", "own", "n").mapInArrow(run, "loss double, n long, g binary")
            loss, n, flat = 0.0, 0, 0.0
            for r in rows.toLocalIterator() if self.size > 20_000 else rows.collect():
                loss, n, flat = loss + r["loss"], n + r["n"], flat + np.frombuffer(r["g"], np.float32).astype(float)
            shared.unpersist()
            if not n:
                continue
            losses.append(loss / n)
            g, at = {}, 0
            for k in sorted(self.p):
                x = self.p[k]
                g[k], at = (flat[at:at + x.size] / n).reshape(x.shape), at + x.size
            self.step(number, g, RATE * (1 - (number - 1) / total))
        return losses

    def table(self) -> np.ndarray:
        """Log-probabilities for all neighbours: flat, by (left * C + right) * C + own."""
        left, right = np.divmod(np.arange(self.size ** 2), self.size)
        z = self.hidden(self.p, left, right) @ self.p["out"] + self.p["bias"]
        return (z - self.norms(self.p, left, right)[:, None]).astype(np.float32).ravel()


def train(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, WindowNetwork]:
    """Vocabulary and network from all documents; the network also carries the word counts."""
    spark = docs.sparkSession
    words = stored(word_counts(docs, text), "words")
    known, tokens = vocabulary(words)
    parts = max(1, -(-tokens // PART_TOKENS))
    counted = triple_counts(docs, known, text).withColumn("part", F.pmod(F.xxhash64("pair"), F.lit(parts)).cast("int"))
    path = scratch_path(spark, "llm-triples")
    counted.sortWithinPartitions("part", "pair", "own").write.partitionBy("part").parquet(path)
    triples = spark.read.schema(counted.schema).parquet(path)
    network = WindowNetwork(n_classes(known))
    marginal = np.zeros(network.size, np.int64)
    for r in triples.groupBy("own").agg(F.sum("n").alias("n")).collect():       # one row per class
        marginal[r["own"]] = r["n"]
    if triples.count() <= LOCAL_TRIPLES:
        rows = triples.select("pair", "own", "n").toArrow()
        pair, own, n = (rows[c].to_numpy() for c in ("pair", "own", "n"))
        order = np.lexsort((own, pair))
        network.fit_rows(pair[order], own[order], n[order])
    else:
        network.start(marginal)
        network.fit_parts(triples, parts)
    network.words = words
    network.inside = np.where(np.arange(network.size) < network.size - SHARED, 0.0, -np.log(marginal + 1.0))
    return known, network


def _pair_norms(spark, network: WindowNetwork) -> np.ndarray | None:
    """Normalisers of all pairs of neighbours, by left * C + right; None if they are too many to send."""
    import pyarrow as pa

    c = network.size
    if c * c > NORMS:
        return None
    shared = spark.sparkContext.broadcast(network.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [WindowNetwork.norms(shared.value, np.full(c, x.as_py()), np.arange(c)).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["at", "norms"])

    out = np.zeros((c, c), np.float32)
    for r in spark.range(c).mapInArrow(run, "at long, norms binary").collect():
        out[r["at"]] = np.frombuffer(r["norms"], np.float32)
    return out.ravel()


def score(docs: DataFrame, known: np.ndarray, network: WindowNetwork, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``log_likelihood`` (sum) and ``mean_log_likelihood``."""
    import pyarrow as pa

    spark, size = docs.sparkSession, network.size
    given = docs.select(docs[f"`{id_col}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    shared = spark.sparkContext.broadcast((known, network.p, network.inside, _pair_norms(spark, network)))
    names = ["uid", "k", "n", "total", "rare"]
    entry = pa.struct([("word", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p, inside, norms = shared.value
        out, uid = np.ascontiguousarray(p["out"].T), TaskContext.get().partitionId() << 40
        for b in batches:
            for first, texts in steps(b.column(1)):
                scan = Scan(texts)
                left, own, right = classes(scan, known)
                pair = left * size + right
                if norms is None:
                    seen, at = np.unique(pair, return_inverse=True)
                    norm = WindowNetwork.norms(p, seen // size, seen % size)[at]
                else:
                    norm = norms[pair]
                gained = np.einsum("ij,ij->i", WindowNetwork.hidden(p, left, right), out[own]) + p["bias"][own] - norm
                gained = gained.astype(float) + inside[own]
                # words of shared classes: (document, word, times)
                rare = np.flatnonzero(own >= size - SHARED)
                doc, word = scan.doc[rare], scan.hash[rare]
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(doc))).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))]).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(word[new].view(np.int64)), pa.array(times)], fields=list(entry))
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(len(texts))), b.column(0).slice(first, len(texts)), pa.array(np.bincount(scan.doc, minlength=len(texts)).astype(np.int64)),
                    pa.array(np.bincount(scan.doc, gained, len(texts)).astype(float)), pa.ListArray.from_arrays(pa.array(offsets), entries)], names)
                uid += len(texts)

    base = stored(given.mapInArrow(run, T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("k", given.schema["k"].dataType), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.IntegerType())])))])), "class_scores")
    # a word that occurs once, and one that was not counted, adds ln 1
    shares = base.select("uid", F.inline("rare")).join(network.words.filter("n > 1"), "word").groupBy("uid").agg(F.sum(F.col("times") * F.log("n")).alias("share"))
    total = F.col("total") + F.coalesce("share", F.lit(0.0))
    return base.select("uid", "k", "n", "total").join(shares, "uid", "left").select(
        F.col("k").alias(id_col), F.col("n").alias("n_tokens"), F.round(total, 4).alias("log_likelihood"),
        F.when(F.col("n") > 0, F.round(total / F.col("n"), 6)).alias("mean_log_likelihood"))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return score(docs, *train(docs, text), id_col, text)
