"""How the given tables stand in for clips, scores and streams, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.operators.running import ordinal_by_bucket, time_bucket
from echoloom.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(c, digits: int = 6) -> Column:
    """Rounded output without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---- lineitem: a scored corpus ----------------------------------------------------------------

def corpus(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """``dealt`` deals a table of few splits over all cores, for jobs that draw for every row."""
    li = table(spark, sf, "lineitem")
    if dealt:
        li = spread(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus"))
    y = (F.col("l_returnflag") == "R").cast("int")
    q = F.least(F.lit(9999), (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729
                              + F.col("l_linenumber") * 31) % 7000 + F.lit(3000) * y)
    return li.select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_key"),
        y.alias("y"), q.alias("q"), (q / F.lit(10000.0)).alias("p"),
        F.concat("l_returnflag", "l_linestatus").alias("bucket"),
        F.col("l_returnflag").alias("content"), F.col("l_linestatus").alias("recipe"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("ord"))


LI = """li AS (
  SELECT *, q / 10000.0::DOUBLE AS p FROM (
    SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                     CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_key,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
           least(9999, (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 7000
                 + 3000 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS q,
           l_returnflag || l_linestatus AS bucket, l_returnflag AS content, l_linestatus AS recipe,
           l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_orderkey AS ord
    FROM lineitem))"""


# ---- events: score streams --------------------------------------------------------------------

def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """stream, step, p, gated, class, value, event_id, ts_us; one step is 100 ms."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("stream"), F.timestamp_diff("MICROSECOND", _epoch(), F.col("ts")).alias("ts_us"), "event_id", F.col("event_type").alias("class"), "value", "props")
    placed = ordinal_by_bucket(ev, ["stream"], ["ts_us", "event_id"], time_bucket("ts_us"), "step")
    return placed.withColumn("p", F.least(F.lit(1.0), F.col("value") / 150.0)).withColumn(
        "gated", F.col("value") < 5.0)


EV = """ev AS (
  SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
         least(1.0, value / 150.0)::DOUBLE AS p, value < 5.0 AS gated, event_type AS class, value,
         event_id, ts, props
  FROM events)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("stream"))


def trials(streams_df: DataFrame) -> DataFrame:
    """One trial per stream: SNR, keyword start and end in samples. Derived from the stream id."""
    s = streams_df.select("stream").distinct()
    return s.select(
        "stream",
        F.element_at(F.array(*[F.lit(v) for v in (20.0, 12.0, 6.0, 0.0)]), (1 + F.col("stream") % 4).cast("int")).alias("snr"),
        ((10 + F.col("stream") % 7) * 1600).alias("kw_start"),
        ((10 + F.col("stream") % 7) * 1600 + 4000 + (F.col("stream") % 5) * 1000).alias("kw_end"))


TRIALS = """trials AS (
  SELECT stream, CASE stream % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 12.0 WHEN 2 THEN 6.0 ELSE 0.0 END::DOUBLE AS snr,
         (10 + stream % 7) * 1600 AS kw_start, (10 + stream % 7) * 1600 + 4000 + (stream % 5) * 1000 AS kw_end
  FROM (SELECT DISTINCT user_id AS stream FROM events))"""


# ---- embeddings: signals ----------------------------------------------------------------------

def signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"), F.col("label").alias("class"),
        F.col("embedding").cast("array<double>").alias("x"))


EM = "em AS (SELECT vec_id AS clip_id, label AS class, embedding::DOUBLE[] AS x FROM embeddings)"


# ---- documents: transcripts -------------------------------------------------------------------

def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("utt_id"), F.col("source").alias("speaker"), F.col("lang").alias("class"),
        F.filter(F.split(F.lower("text"), r"[ \n\t\r]+"), lambda w: w != "").alias("words"), "text")


TR = """tr AS (
  SELECT doc_id AS utt_id, source AS speaker, lang AS class,
         list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '') AS words, text
  FROM documents)"""


def clip_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("clip_id"), F.col("url").alias("path"),
        F.encode("html", "utf-8").alias("content"))


PG = "pg AS (SELECT page_id AS clip_id, url AS path, encode(html) AS content FROM pages)"


# ---- SQL helpers ------------------------------------------------------------------------------

def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    def one(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def detector_sql(policies, source: str = "ev") -> str:
    """CTEs ``pol`` and ``det(stream, pid, step)``: a recursion that steps through every stream."""
    pol = values_sql("pol", "pid, thr, agg, need, span, refr, variant, alpha, decay, keep", [
        (i, float(p.threshold), p.agg, p.need, p.span, p.refractory, p.variant, p.alpha, p.decay, p.keep_score)
        for i, p in enumerate(policies)])
    return f"""{pol},
run(stream, pid, step, hold, mean, hist, lck, fired) AS (
  SELECT s.stream, p.pid, (-1)::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, false
  FROM (SELECT DISTINCT stream FROM {source}) s, pol p
  UNION ALL
  SELECT stream, pid, step,
         CASE WHEN fired AND NOT keep THEN 0.0 ELSE hold2 END,
         CASE WHEN fired AND NOT keep THEN 0.0 ELSE mean2 END,
         CASE WHEN fired THEN 0 ELSE hist2 END, CASE WHEN fired THEN refr ELSE lck2 END, fired
  FROM (SELECT *, (NOT gated AND bit_count(hist2) >= need AND lck2 = 0 AND (variant = 'scan' OR hit = 1)) AS fired
        FROM (SELECT *, (hist * 2 + hit) & ((1::BIGINT << span) - 1) AS hist2
              FROM (SELECT *, CASE WHEN NOT gated AND (CASE WHEN agg = 'maxhold' THEN hold2 ELSE mean2 END) >= thr
                              THEN 1 ELSE 0 END AS hit
                    FROM (SELECT r.stream, r.pid, r.step + 1 AS step, r.hist, greatest(r.lck - 1, 0) AS lck2,
                                 e.gated, p.thr, p.agg, p.need, p.span, p.refr, p.variant, p.keep,
                                 greatest(CASE WHEN e.gated THEN 0.0 ELSE e.p END, r.hold * p.decay) AS hold2,
                                 p.alpha * (CASE WHEN e.gated THEN 0.0 ELSE e.p END) + (1.0 - p.alpha) * r.mean AS mean2
                          FROM run r JOIN pol p ON p.pid = r.pid
                          JOIN {source} e ON e.stream = r.stream AND e.step = r.step + 1))))),
det AS (SELECT stream, pid, step FROM run WHERE fired)"""
