"""Benchmark decontamination by template windows.

Texts and benchmark items are brought to templates: numbers, names and units
become typed placeholders, all other words stay, in lower case. A number keeps its separators
("12,500", "2.5") and may be written in words ("twenty-five"); capitalised words in a row, in any script that
has capitals, are one name ("Mary Jane"); a unit is a unit word after a number. Windows
of ``WINDOW`` template tokens are hash-joined. Matches of a document and an item on one alignment
(document position minus item position) must fill the slots consistently: one value of the item
always stands for one value of the document, and the other way round; windows with a slot that
does not are not counted. An item is leaked into a document if enough of its windows are found.

So a question copied word for word is found, and so is one with other numbers and names. Beside its
template, each window is matched as literal words with case folded, since a copy in another case has
other names; a window counts as found if either matches. An item without a window of enough plain words
(all capitals, mostly digits) has all its literal windows instead.

Documents are scanned once. A fixed-size bitmap of the item window hashes keeps most windows from
leaving the scan; what passes is joined exactly. The bitmap does not grow with either table.

Defined results for odd input: a NULL or blank text has no windows. An item with fewer than
``WINDOW`` tokens is matched as literal words only and is reported, but no document is dropped for it; one with fewer
than ``SHORT`` must be found whole. An item without tokens matches nothing. Equal
items are reported each. Rows that repeat id and text are one document; documents without an id are
reported under NULL, each by its own text. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import broadcast_if_small, stored
from echoloom.llm.tokenscan import Scan, powers, steps

WINDOW = 6
#: share of an item's windows that must be found in a document
MIN_SHARE = 0.3
#: at least so many tokens of a window must be words, not placeholders
MIN_WORDS = 2
#: an item with fewer tokens must be found in all its windows, and they need SHORT_WORDS words
SHORT = 9
SHORT_WORDS = 4
#: the bitmap has 2 ** BITS bits (512 KB)
BITS = 22
UNITS = ("kg g mg lb lbs oz ton tons km m cm mm mile miles foot feet inch inches yard yards l ml litre litres liter liters "
         "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros "
         "pound pounds cent cents percent degree degrees").split()
NUMBER_WORDS = ("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()

MIX = np.uint64(0x94D049BB133111EB)
NUMBER, NAME, UNIT = (np.uint64(v) for v in (0xA5A5A5A5A5A5A5A1, 0xA5A5A5A5A5A5A5A2, 0xA5A5A5A5A5A5A5A3))
LITERAL = np.uint64(0x5C5C5C5C5C5C5C5C)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(Scan([" ".join(words).encode()]).hash)


UNIT_HASHES = _hashes(UNITS)
NUMBER_HASHES = _hashes(NUMBER_WORDS)
#: which code points below 65 536 are capitals
CAPITAL = np.array([chr(i).isupper() or chr(i).istitle() for i in range(1 << 16)])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h


def _capitals(b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the character at each of ``start`` is a capital; UTF-8 of one to three bytes."""
    at = [b[np.minimum(start + i, len(b) - 1)].astype(np.int32) for i in range(3)]
    code = np.where(at[0] < 0x80, at[0], np.where(at[0] < 0xE0, (at[0] & 0x1F) << 6 | at[1] & 0x3F, (at[0] & 0x0F) << 12 | (at[1] & 0x3F) << 6 | at[2] & 0x3F))
    return CAPITAL[code] & (at[0] < 0xF0)


class Template:
    """Template tokens of a scan: ``hash``, ``kind`` (0 word, 1 number, 2 name, 3 unit), ``start`` and ``stop`` in its bytes, ``doc``, and ``raw``, the first scan token of each."""

    def __init__(self, scan: Scan):
        n = len(scan.start)
        kind = np.zeros(n, np.int8)
        self.data, self.raw = scan.data, np.arange(n)
        if n:
            b = np.frombuffer(scan.data, np.uint8)
            digits = np.maximum.reduceat((b[scan.pos] >= 48) & (b[scan.pos] <= 57), scan.first)
            spelt = _among(scan.hash, NUMBER_HASHES) & ~digits
            kind[_capitals(b, scan.start)] = 2
            kind[digits | spelt] = 1
            same = scan.doc[1:] == scan.doc[:-1]
            after = np.zeros(n, bool)
            after[1:] = (kind[:-1] == 1) & same
            kind[after & _among(scan.hash, UNIT_HASHES) & (kind != 1)] = 3
            # a token goes on with the one before it if a single byte that fits its kind stands between them
            gap = b[scan.stop[:-1]]
            near = same & (scan.start[1:] - scan.stop[:-1] == 1)
            space = (gap == 32) | (gap == 45)
            decimal = digits[1:] & digits[:-1] & ((gap == 44) | (gap == 46))
            words = spelt[1:] & spelt[:-1] & space
            names = (kind[1:] == 2) & (kind[:-1] == 2) & (space | (gap == 39))
            self.raw = np.flatnonzero(np.append(True, ~(near & (decimal | words | names))))
        self.kind = kind[self.raw]
        self.start, self.stop, self.doc = scan.start[self.raw], scan.stop[np.append(self.raw[1:], n)[:n] - 1], scan.doc[self.raw]
        self.hash = np.select([self.kind == 1, self.kind == 2, self.kind == 3], [NUMBER, NAME, UNIT], scan.hash[self.raw])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, hash, words) of all windows of ``size`` tokens inside one text."""
        at, h = _window_hashes(self.hash, self.doc, size)
        count = np.concatenate([[0], np.cumsum(self.kind == 0)])
        return at, h, count[at + size] - count[at]

    def slots(self, at: int, size: int) -> list[str]:
        """The slot values of a window, each with its kind in front, so that values of two kinds never meet."""
        return [f"{self.kind[i]}{self.data[self.start[i]:self.stop[i]].decode('utf-8', 'replace').lower()}" for i in range(at, at + size) if self.kind[i]]


def _window_hashes(t: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(t) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = powers(size, int(MIX)), np.zeros(n, np.uint64)
    for k in range(size):
        h += (t[k:k + n] ^ (t[k:k + n] >> np.uint64(31))) * p[k]
    h ^= h >> np.uint64(30)
    h *= MIX
    h ^= np.uint64(size)
    same = np.flatnonzero(doc[:n] == doc[size - 1:])
    return same, h[same]


def folded(texts: list[bytes], scan: Scan) -> np.ndarray:
    """Hash of each token of ``scan`` with case folded; the scan itself folds ASCII only."""
    if all(t.isascii() for t in texts):
        return scan.hash
    return Scan([t if t.isascii() else t.decode("utf-8", "replace").casefold().encode() for t in texts]).hash


def literal_windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of all windows of ``size`` words; the hashes are apart from those of templates."""
    at, h = _window_hashes(words, doc, size)
    return at, (h ^ LITERAL) * MIX


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, i_pos, i_at, size, h, i_slots, n_windows, n_tokens) for every window of every item, as template and as literal words (no slots).

    ``i_pos`` is the window's first word, ``i_at`` its first template token, which is what alignments are counted in.
    """
    import pyarrow as pa

    given = items.select(items[f"`{id_col}`"].alias("k"), items[f"`{text}`"].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, v in enumerate(b.column(1)):
                texts = [(v.as_py() or "").encode()]
                scan = Scan(texts)
                n = len(scan.start)
                size = min(WINDOW, n)
                if size:
                    made = Template(scan)
                    at, h, known = made.windows(WINDOW)
                    good = known >= (SHORT_WORDS if n < SHORT else MIN_WORDS)
                    at, h = at[good], h[good].view(np.int64)
                    p_all, literal = literal_windows(folded(texts, scan), scan.doc, size)
                    chosen = made.raw[at] if len(at) else p_all       # a template window holds as many words as a literal one, or more
                    key = b.column(0)[i].as_py()
                    rows += [(key, int(made.raw[p]), int(p), size, int(x), made.slots(p, size), len(chosen), n) for p, x in zip(at, h, strict=True)]
                    rows += [(key, int(p), int(p), size, int(x), [], len(chosen), n) for p, x in zip(chosen, literal[chosen].view(np.int64), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "i_pos", "i_at", "size", "h", "i_slots", "n_windows", "n_tokens"])

    return given.mapInArrow(run, T.StructType([
        T.StructField("item", given.schema["k"].dataType), T.StructField("i_pos", T.LongType()), T.StructField("i_at", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("h", T.LongType()), T.StructField("i_slots", T.ArrayType(T.StringType())), T.StructField("n_windows", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def doc_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray, id_col: str, text: str) -> DataFrame:
    """(k, text_key, d_pos, h, d_slots) of the document windows whose hash may be one of an item; ``d_pos`` counts template tokens for templates, else words."""
    import pyarrow as pa
    import xxhash

    given = docs.select(docs[f"`{id_col}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)                  # 2 ** BITS bits, whatever the tables hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            for first, texts in steps(b.column(1)):
                scan, rows, at, hs, slots = Scan(texts), [], [], [], []
                words, made = folded(texts, scan), Template(scan)
                for doc, (p, h), typed in ((made.doc, made.windows(WINDOW)[:2], True), *((scan.doc, literal_windows(words, scan.doc, size), False) for size in sizes)):
                    cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    hit = np.flatnonzero(bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                    rows += (first + doc[p[hit]]).tolist()
                    at += p[hit].tolist()
                    hs.append(h[hit].view(np.int64))
                    slots += [made.slots(i, WINDOW) if typed else [] for i in p[hit]]
                keys = [_signed(xxhash.xxh64_intdigest(texts[r - first], 42)) for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(at, pa.int64()),
                                                  pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                                                 ["k", "text_key", "d_pos", "h", "d_slots"])

    return given.mapInArrow(run, T.StructType([
        T.StructField("k", given.schema["k"].dataType), T.StructField("text_key", T.LongType()), T.StructField("d_pos", T.LongType()),
        T.StructField("h", T.LongType()), T.StructField("d_slots", T.ArrayType(T.StringType()))]))


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bitmap of the top hash bits; at most 2 ** BITS / 8 rows reach the driver."""
    cell = F.shiftrightunsigned("h", 64 - BITS)
    bits = items.select(cell.alias("c")).groupBy(F.shiftright("c", 3).alias("byte")).agg(
        F.bit_or(F.expr("cast(shiftleft(1, cast(c & 7 AS int)) AS int)")).alias("value"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in bits.toLocalIterator():
        out[row["byte"]] = row["value"]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          min_share: float = MIN_SHARE) -> DataFrame:
    """One row per leaked pair: document id, ``text_key``, item id, windows of the item, windows found."""
    return _leaks(docs, benchmark, id_col, text, item_id, item_text, min_share).drop("n_tokens")


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_id: str, item_text: str, min_share: float) -> DataFrame:
    items = stored(item_windows(benchmark, item_id, item_text), "item_windows")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]   # at most WINDOW rows
    found = doc_windows(docs, sizes, _bitmap(items), id_col, text)
    # a window that very many documents share is a hot key on the documents' side only: a small item table
    # is broadcast, and for a large one adaptive execution splits the key
    match = stored(found.join(broadcast_if_small(items), "h").select(
        "k", "text_key", "item", (F.col("d_pos") - F.col("i_at")).alias("shift"), "i_pos", "i_slots", "d_slots", "n_windows", "n_tokens").distinct(), "matches")
    line = ["k", "text_key", "item", "shift"]
    pairs = match.select(*line, F.explode(F.arrays_zip("i_slots", "d_slots")).alias("p")).select(*line, F.col("p.i_slots").alias("i"), F.col("p.d_slots").alias("d")).distinct()
    torn = pairs.groupBy(*line, "i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*line, F.col("i").alias("slot"), F.lit("i").alias("side")).unionByName(
        pairs.groupBy(*line, "d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*line, F.col("d").alias("slot"), F.lit("d").alias("side")))
    torn = torn.groupBy(*line).agg(F.collect_set(F.when(F.col("side") == "i", F.col("slot"))).alias("i_torn"),
                                   F.collect_set(F.when(F.col("side") == "d", F.col("slot"))).alias("d_torn"))
    m, t = match.alias("m"), torn.alias("t")
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in line]
    none = F.array().cast("array<string>")
    good = m.join(t, on[0] & on[1] & on[2] & on[3], "left").filter(
        ~F.arrays_overlap("i_slots", F.coalesce("i_torn", none)) & ~F.arrays_overlap("d_slots", F.coalesce("d_torn", none)))
    return good.groupBy("m.k", "m.text_key", "m.item").agg(F.first("n_windows").alias("n_windows"), F.first("n_tokens").alias("n_tokens"), F.countDistinct("i_pos").alias("n_found")).filter(
        F.col("n_found") >= F.col("n_windows") * F.when(F.col("n_tokens") < SHORT, 1.0).otherwise(min_share)).select(
        F.col("k").alias(id_col), "text_key", F.col("item").alias(item_id), "n_windows", "n_found", "n_tokens")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leaked item of ``WINDOW`` tokens or more. Texts do not move while the list of leaked documents is small."""
    leaked = _leaks(docs.select(docs[f"`{id_col}`"].alias("own_key"), docs[f"`{text}`"].alias("own_text")), benchmark, "own_key", "own_text",
                    "item_id", "text", MIN_SHARE).filter(F.col("n_tokens") >= WINDOW)
    bad = broadcast_if_small(stored(leaked.select("own_key", "text_key").distinct(), "leaked"))
    # a document without id is known by its text; Spark's xxhash64 starts from 42, the scan from the same seed
    same = docs[f"`{id_col}`"].eqNullSafe(bad["own_key"]) & (F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))) == bad["text_key"])
    return docs.join(bad, same, "left_anti")
