"""Host-level quality rules, native expressions only.

Each document gets four measures and a base verdict from its own text. Base failures are then
aggregated by host, the failure rate of each host is shrunk with a beta prior estimated from all
hosts (method of moments), and the host verdict is joined back to the documents.

Defined results for odd input: a NULL or blank text has no words and fails the base rule. A NULL
host is a host of its own. Repeated rows count and come back as often as they occur. Columns
beyond the named ones are ignored by ``judge`` and kept by ``keep_good``. An empty table gives an
empty result. A passage repeated in a text is found by 64-bit hashes of its five-word windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import broadcast_if_small, fresh, stored, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: a host is rejected if its shrunken failure rate is above this
MAX_HOST_RATE = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _window_hashes(w: Column) -> Column:
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(w) - F.lit(WINDOW - 1), F.lit(0)))


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` (under positional names ``k0``, ``k1``, ...) with the five measures and ``base_failed``."""
    df = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    df = df.withColumns({"w": words(F.col("t")), "lines": _lines_with_words(F.col("t"))})
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count(F.col("t"), F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h": _window_hashes(F.col("w"))}).drop("t", "w", "lines")
    # sorting is needed only where some window occurs twice; equal hashes end up side by side
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    ranked = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("s", F.when(repeats, ranked)).drop("h")
    s = F.col("s")
    same = lambda p, q: F.coalesce(p["x"] == q["x"], F.lit(False))
    again = F.filter(s, lambda p, k: same(p, F.get(s, k - 1)) | same(p, F.get(s, k + 1)))
    starts = F.sort_array(F.transform(again, lambda p: p["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")))
    df = df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("s")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: documents, base failures, shrunken failure rate and ``rejected``.

    The prior is a beta distribution with the pooled failure rate m as mean. Its weight a+b comes
    from the variance of the host rates beyond what binomial noise explains; if nothing is left,
    hosts do not differ and every host gets m. One row per host; partial sums are made before
    the shuffle, so a hot host costs no more than a rare one.
    """
    per_host = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    per_host = stored(per_host, "hosts")
    total = per_host.agg(F.sum("n").cast("double").alias("all_n"), F.sum("bad").cast("double").alias("all_bad"),
                         F.count(F.lit(1)).cast("double").alias("n_hosts"),
                         F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("square"))
    mean = F.col("all_bad") / F.col("all_n")
    spread = F.col("square") / F.col("all_n") - mean * mean
    noise = mean * (1 - mean) * F.col("n_hosts") / F.col("all_n")
    between = F.greatest(spread - noise, F.lit(0.0))
    weight = F.when(between > 1e-12, F.greatest(mean * (1 - mean) / F.nullif(between, F.lit(0.0)) - 1, F.lit(0.0)))
    prior = total.select(mean.alias("m"), weight.alias("s"))           # one row: bounded by construction
    shrunk = F.when(F.col("s").isNull(), F.col("m")).otherwise((F.col("bad") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")))
    return per_host.join(F.broadcast(prior)).select("host", "n", "bad", shrunk.alias("rate"), (shrunk > max_rate).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: id, host, measures, ``base_failed``, host counts and ``kept``."""
    own = stored(measured(docs, text, [id_col, host]), "measures")
    hosts = broadcast_if_small(stored(host_verdicts(own, "k1", max_rate), "verdicts"))
    return own.join(hosts, F.col("k1").eqNullSafe(F.col("host")), "left").select(
        F.col("k0").alias(id_col), *MEASURES, "base_failed",
        (~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))).alias("kept"),
        F.col("k1").alias("host"), F.col("n").alias("host_docs"), F.col("bad").alias("host_failed"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and come from a host that is not rejected.

    Texts never move: the verdict is an expression over the row, and only rejected hosts are joined.
    """
    columns = docs.columns
    own = stored(measured(docs, text, [host]).select("k0", "base_failed"), "failures")
    bad = host_verdicts(own, "k0", max_rate).filter("rejected").select("host")
    bad = broadcast_if_small(stored(bad, "rejected"))
    row = fresh(docs, "packed_row")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias(row), F.col(f"`{text}`").alias("body_text"),
                         F.col(f"`{host}`").alias("body_host"))
    # the verdict goes through a generator: a plain filter would be pushed into the measures, which would
    # then be computed again for every use of a word list
    passed = measured(packed, "body_text", [row, "body_host"]).select("k0", "k1", F.explode(F.array("base_failed")).alias("failed")).filter("NOT failed")
    return passed.join(bad, F.col("k1").eqNullSafe(F.col("host")), "left_anti").select("k0.*")
