"""Mixing sources to target weights by hash-random keys, range buckets and distributed prefix sums.

1. Documents are measured in words; sizes are summed by source.
2. Every source gets a weight by its place in code-point order. The mix has ``share`` times all words;
   a source's target is its weighted part, held at ``most`` times its size, and what a held source
   cannot take is shared among the others by weight. Sources sorted by size over weight are held in
   that order, so prefix sums over the sources give the one level at which the rest is shared.
3. A target is whole epochs of the source and a rest. Each document has a hash-random key per epoch;
   within its source the keys fall into equal ranges, a few hundred documents each. Word counts are
   summed by range and accumulated over the ranges, which finds the range where the rest runs out:
   documents in lower ranges are taken whole, those in higher ranges not at all.
4. Only that one range of each source is sorted. The document at which the budget runs out gives just
   the words that are missing, so a source gives floor(target) words exactly.

Nothing but (id, source, size) is written and only sums by range are shuffled. A hot source has more
ranges, not larger ones. Keys depend on seed, epoch and id, so reruns and any partitioning agree.

Defined results for odd input: a NULL text has size 0. A NULL source is a source of its own, the last.
A NULL id has the key of the empty id. Equal keys are ordered by id and size; rows equal in all of
these are told apart by their position in the table, which changes no multiset of results. A source
without words has target 0. Repeated rows count each. Other columns are ignored by ``plan`` and kept
by ``mixed``. An empty table gives an empty result. Texts of any length are measured whole.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.common import WORD, broadcast_if_small, stored
from echoloom.operators.running import listing_ordinal, ordinal_by_bucket, running

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix-1"
#: documents of a source that fall into one range of keys, on average
RANGE_ROWS = 512
KEY_BITS = 60
#: key bits that choose the range
TOP = 30


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def sizes(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(id, src, size) of every row."""
    return docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source}`"].alias("src"),
                       F.coalesce(F.regexp_count(docs[f"`{text}`"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """Per source: ``source_size``, ``n`` rows, ``weight``, ``target``, whole ``epochs`` and the ``rest`` of the budget in words."""
    per = measured.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = listing_ordinal(per, [F.col("src").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    # size over weight, as an integer
    per = stored(listing_ordinal(per.withColumn("fill", F.col("source_size") * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")),
                                 ["fill", "place"], "turn"), "sources")
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    num, den = share.numerator, share.denominator
    total, heavy = int(whole["size"] or 0), int(whole["weight"] or 0)
    filled = running(per, [], ["turn"], F.floor(F.col("turn") / 4096),
                     {"size_before": ("sum", F.col("source_size"), False), "weight_before": ("sum", F.col("weight"), False)})
    # the first source that its part does not fill, when all before it are held
    fits = (_exact(F.col("source_size") * (most * den)) * _exact(F.lit(heavy) - F.col("weight_before"))
            >= _exact(F.lit(num * total) - F.col("size_before") * (most * den)) * _exact(F.col("weight")))
    level = filled.filter(fits).agg(F.min(F.struct("turn", "size_before", "weight_before")).alias("l")).first()["l"]
    turn = level["turn"] if level else 1 << 62
    left = num * total - den * most * level["size_before"] if level else 0
    over = den * (heavy - level["weight_before"]) if level else 1
    held = F.col("turn") < turn
    part = F.lit(left) * F.col("weight")
    budget = F.when(held, F.col("source_size") * most).otherwise(F.expr(f"({left}L * weight) div {over}L"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    return (per.withColumn("target", F.when(held, (F.col("source_size") * most).cast("double")).otherwise(part.cast("double") / F.lit(float(over))))
            .withColumn("budget", budget).withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .select(F.col("src").alias("of"), "source_size", "n", "weight", "target", "epochs", "rest"))


def _keyed(rows: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """Rows with their source's columns, the key of the last epoch and the range ``b`` it falls into."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranges = F.ceil(F.col("n") / F.lit(RANGE_ROWS)).cast("long")
    return (rows.join(per, F.col("src").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("key", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long"))
            .withColumn("b", F.shiftright(F.shiftright("key", KEY_BITS - TOP) * ranges, TOP)))


def _cuts(measured: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """``per`` with the range ``cut`` in which each source's rest runs out and the words ``before`` that range."""
    sums = _keyed(measured, per, seed).groupBy("src", "b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = running(stored(sums, "ranges"), ["src"], ["b"], F.floor(F.col("b") / 4096), {"before": ("sum", F.col("words"), False)})
    cut = (sums.filter("before <= rest AND rest < before + words").groupBy("src")       # one range of each source with words
           .agg(F.min(F.struct(F.col("b").alias("cut"), "before")).alias("c")).select(F.col("src").alias("s"), "c.*"))
    return per.join(cut, F.col("of").eqNullSafe(F.col("s")), "left").drop("s")


def _taken(rows: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """``rows`` (id, src, size, ...) with source columns, ``key`` and ``part``: the words taken in the last epoch."""
    keyed = _keyed(rows, cuts, seed)
    at_cut = F.coalesce(F.col("b") == F.col("cut"), F.lit(False))
    clear = keyed.filter(~at_cut).withColumn("part", F.when(F.col("b") < F.col("cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    edge = stored(keyed.filter(at_cut).withColumn("rid", F.monotonically_increasing_id())
                  .withColumn("who", F.struct("src", "key", "id", "size")), "edge")
    # equal rows are one group with a count, so that no group of copies is sorted
    groups = edge.groupBy("who").agg(F.count(F.lit(1)).alias("copies"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy(F.col("who")["src"]).orderBy(F.col("who")["key"], F.col("who")["id"], F.col("who")["size"])
    reach = F.coalesce(F.sum(F.col("copies") * F.col("who")["size"]).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("who", (F.col("rest") - F.col("before") - reach).alias("allowed"), "copies")
    edge = edge.join(groups, "who")
    split = (F.col("allowed") > 0) & (F.col("allowed") < F.col("copies") * F.col("size"))
    plain = edge.filter(~split).withColumn("part", F.when(F.col("allowed") > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    torn = ordinal_by_bucket(edge.filter(split), ["who"], ["rid"], F.floor(F.col("rid") / 8192), "turn")
    torn = torn.withColumn("part", F.least(F.greatest(F.col("allowed") - F.col("turn") * F.col("size"), F.lit(0)), F.col("size")))
    return clear.select(*clear.columns).unionByName(plain.select(*clear.columns)).unionByName(torn.select(*clear.columns))


def _prepared(docs: DataFrame, id_col: str, text: str, source: str, weights, share, most, seed) -> tuple[DataFrame, DataFrame]:
    own = stored(sizes(docs, id_col, text, source), "sizes")
    per = broadcast_if_small(stored(targets(own, weights, share, most), "targets"))
    return own, broadcast_if_small(stored(_cuts(own, per, seed), "cuts"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
         share: Fraction = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, whole ``epochs`` and the words ``taken`` in all."""
    own, cuts = _prepared(docs, id_col, text, source, weights, share, most, seed)
    out = _taken(own, cuts, seed)
    return out.select(F.col("id").alias(id_col), F.col("src").alias("mix_source"), "size", "source_size", "target", "epochs",
                      (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
          share: Fraction = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs`` once per epoch that takes the document, with ``mix_epoch`` (from 0),
    ``mix_words`` (words of the text this copy gives; the others of its words are cut off) and the hash-random ``mix_key``
    of that epoch. Rows are range-sorted by source, epoch and key, so they can be written and read in mix order.
    A document without words takes no part.

    New columns replace columns of the same name.
    """
    _, cuts = _prepared(docs, id_col, text, source, weights, share, most, seed)
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(docs[f"`{c}`"].alias(a) for c, a in ((id_col, "id"), (source, "src"))),
                         F.coalesce(F.regexp_count(docs[f"`{text}`"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    taken = _taken(packed, cuts, seed)
    copies = F.expr("sequence(0L, epochs)")
    out = taken.withColumn("e", F.explode(copies)).withColumn("w", F.when(F.col("e") < F.col("epochs"), F.col("size")).otherwise(F.col("part"))).filter("w > 0")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("e"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    out = out.withColumn("k", F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long"))
    # a text cut after w words: the matches up to there, with the white space before each
    some = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("w").cast("int")), "")
    body = F.when(F.col("w") < F.col("size"), some).otherwise(F.col(f"row.`{text}`"))
    extra = {"mix_epoch": F.col("e"), "mix_words": F.col("w"), "mix_key": F.col("k")}
    keep = [(body if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c.lower() not in extra]
    out = out.repartitionByRange(F.col("src"), F.col("e"), F.col("k"), F.col("id")).sortWithinPartitions("src", "e", "k", "id")
    return out.select(*keep, *(v.alias(c) for c, v in extra.items()))
