"""M and K families over the scored corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import LI, corpus, r6
from echoloom.catalog.registry import query
from echoloom.operators import metrics as M
from echoloom.operators import ranking as K
from echoloom.operators.running import exact_quantiles
from echoloom.plans import dims
from echoloom.session import inline_table

THR = 0.68
GRID20 = [round(0.05 * i, 2) for i in range(1, 20)]


def _list(vals) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in vals) + "]"


RATES = """round(CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0 END, 6) AS tpr,
  round(CASE WHEN n_neg > 0 THEN fp / n_neg ELSE 0 END, 6) AS fpr"""


@query("m1_confusion_at_threshold", f"""WITH {LI}
SELECT tp, fn, fp, tn, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr,
       round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy
FROM (SELECT count(*) FILTER (y = 1 AND p >= {THR}) AS tp, count(*) FILTER (y = 1 AND p < {THR}) AS fn,
             count(*) FILTER (y = 0 AND p >= {THR}) AS fp, count(*) FILTER (y = 0 AND p < {THR}) AS tn FROM li)""")
def m1(spark, sf):
    c = M.confusion(corpus(spark, sf), THR)
    return c.select("tp", "fn", "fp", "tn", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("accuracy").alias("accuracy"))


@query("p9_decision_labels", f"""WITH {LI}
SELECT bucket, CASE WHEN p >= 0.85 THEN 'FALSE ALARM' ELSE 'REJECTED' END AS decision,
       CASE WHEN p >= 0.85 THEN 1 ELSE 0 END AS prediction, count(*) AS n
FROM li WHERE y = 0 GROUP BY ALL""")
def p9(spark, sf):
    neg = corpus(spark, sf).filter("y = 0")
    return (neg.select("bucket", F.when(F.col("p") >= 0.85, "FALSE ALARM").otherwise("REJECTED").alias("decision"),
                       (F.col("p") >= 0.85).cast("int").alias("prediction"))
            .groupBy("bucket", "decision", "prediction").agg(F.count(F.lit(1)).alias("n")))


def _grid_sql(grid):
    return f"""WITH {LI}, g AS (SELECT unnest({_list(grid)}) AS threshold),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
      count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM li, g GROUP BY threshold)
SELECT threshold, tp, fp, {RATES}, round((tp + n_neg - fp) / (n_pos + n_neg), 6) AS accuracy FROM c"""


def _grid(spark, sf, grid):
    t = M.threshold_table(corpus(spark, sf), grid)
    return t.select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("accuracy").alias("accuracy"))


@query("m2_threshold_grid_coarse", _grid_sql(dims.COARSE_GRID))
def m2a(spark, sf):
    return _grid(spark, sf, dims.COARSE_GRID)


@query("m2_threshold_grid_fine", _grid_sql(GRID20))
def m2b(spark, sf):
    return _grid(spark, sf, GRID20)


def _budget_sql(one: bool, by: str = ""):
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    join = f"JOIN tot USING ({by})" if by else ", tot"
    zero = "1.0" if one else "mx"
    return f"""WITH {LI}, b AS (SELECT unnest({_list(dims.FPR_BUDGETS)}) AS budget),
tot AS (SELECT {k} count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
               max(p) FILTER (y = 0) AS mx FROM li {'GROUP BY ' + by if by else ''}),
r AS (SELECT {k} p, row_number() OVER ({part} ORDER BY p DESC) AS rn FROM li WHERE y = 0),
c AS (SELECT tot.*, budget, CAST(floor(budget * n_neg) AS BIGINT) AS allowed FROM tot, b),
t AS (SELECT c.*, CASE WHEN n_neg = 0 THEN 0.5 WHEN allowed = 0 THEN {zero} ELSE r.p END AS threshold,
             allowed = 0 AND n_neg > 0 AND {str(not one).lower()} AS strict
      FROM c LEFT JOIN r ON r.rn = c.allowed {'AND r.' + by + ' = c.' + by if by else ''}),
m AS (SELECT {'t.' + by + ', ' if by else ''} budget, any_value(allowed) AS allowed, any_value(threshold) AS threshold,
        any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg,
        count(*) FILTER (li.y = 1 AND CASE WHEN strict THEN li.p > threshold ELSE li.p >= threshold END) AS tp,
        count(*) FILTER (li.y = 0 AND CASE WHEN strict THEN li.p > threshold ELSE li.p >= threshold END) AS fp
      FROM t JOIN li ON {'li.' + by + ' = t.' + by if by else 'true'} GROUP BY {'t.' + by + ', ' if by else ''} budget)
SELECT {k} budget, allowed, round(threshold, 6) AS threshold, tp, fp, {RATES} FROM m"""


def _budgets(spark, sf, budgets, zero, by=()):
    t = M.at_budgets(corpus(spark, sf), budgets, list(by), zero)
    return t.select(*by, "budget", "allowed", r6("threshold").alias("threshold"), "tp", "fp",
                    r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query("m3_threshold_at_fpr_budget", _budget_sql(False))
def m3(spark, sf):
    return _budgets(spark, sf, dims.FPR_BUDGETS, "above_max")


@query("m4_tpr_at_budget_per_recipe", _budget_sql(False, "recipe"))
def m4(spark, sf):
    return _budgets(spark, sf, dims.FPR_BUDGETS, "above_max", ["recipe"])


@query("m5_roc_over_budgets", _budget_sql(True))
def m5(spark, sf):
    return _budgets(spark, sf, dims.FPR_BUDGETS, "one")


AUC_SQL = """, rk AS (SELECT {k} y, avg(rn) OVER (PARTITION BY {k} p) AS rnk
  FROM (SELECT {k} y, p, row_number() OVER ({part} ORDER BY p) AS rn FROM li)),
au AS (SELECT {k} count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
         sum(rnk) FILTER (y = 1) AS rs FROM rk {grp})
SELECT {k} n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN
  round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM au"""


@query("m6_auc_tie_averaged", "WITH " + LI + AUC_SQL.format(k="", part="", grp=""))
def m6(spark, sf):
    return M.auc(corpus(spark, sf)).select("n_pos", "n_neg", r6("auc").alias("auc"))


@query("m7_auc_per_recipe", "WITH " + LI + AUC_SQL.format(k="recipe, ", part="PARTITION BY recipe", grp="GROUP BY recipe"))
def m7(spark, sf):
    return M.auc(corpus(spark, sf), ["recipe"]).select("recipe", "n_pos", "n_neg", r6("auc").alias("auc"))


PCT = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p50": 0.50, "p95": 0.95, "p99": 0.99, "p999": 0.999, "mx": 1.0}


@query("m8_score_percentiles", f"WITH {LI} SELECT y, " + ", ".join(
    f"round(quantile_cont(p, {q}), 6) AS {n}" for n, q in PCT.items()) + " FROM li GROUP BY y")
def m8(spark, sf):
    q = exact_quantiles(corpus(spark, sf), ["y"], "p", PCT)
    return q.select("y", *[r6(n).alias(n) for n in PCT])


@query("m9_positive_buckets", f"""WITH {LI}
SELECT bucket, count(*) AS n, count(*) FILTER (p >= {THR}) AS hits, round(avg((p >= {THR})::INT), 6) AS recall,
  round(1 - avg((p >= {THR})::INT), 6) AS missed, round(avg(p), 6) AS mean_conf, round(quantile_cont(p, 0.05), 6) AS p05
FROM li WHERE y = 1 GROUP BY bucket""")
def m9(spark, sf):
    t = M.bucket_table(corpus(spark, sf), THR, 1, ["bucket"])
    return t.select("bucket", "n", "hits", *[r6(c).alias(c) for c in ("recall", "missed", "mean_conf", "p05")])


@query("m10_negative_buckets", f"""WITH {LI}
SELECT bucket, count(*) AS n, count(*) FILTER (p >= {THR}) AS fa_count, round(avg((p >= {THR})::INT), 6) AS fa_rate,
  round(avg(p), 6) AS mean_conf, round(quantile_cont(p, 0.95), 6) AS p95
FROM li WHERE y = 0 GROUP BY bucket""")
def m10(spark, sf):
    t = M.bucket_table(corpus(spark, sf), THR, 0, ["bucket"])
    return t.select("bucket", "n", "fa_count", *[r6(c).alias(c) for c in ("fa_rate", "mean_conf", "p95")])


@query("m11_pooled_content_recipe", f"""WITH {LI}
SELECT content, recipe, count(*) AS n, sum(y)::BIGINT AS n_pos, sum(y * (p >= {THR})::INT)::BIGINT AS tp,
       sum((1 - y) * (p >= {THR})::INT)::BIGINT AS fp
FROM li GROUP BY CUBE (content, recipe)""")
def m11(spark, sf):
    return M.pooled(corpus(spark, sf), THR)


WEIGHTS = {"RF": 1.15, "RO": 1.25, "NF": 0.9, "NO": 1.1}


@query("m12_bucket_inventory", f"""WITH {LI}
SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct,
  CASE bucket WHEN 'RF' THEN 1.15 WHEN 'RO' THEN 1.25 WHEN 'NF' THEN 0.9 WHEN 'NO' THEN 1.1 ELSE 1.0 END::DOUBLE AS weight,
  round(min(20 * log10(p + 1e-9)), 6) AS min_level, round(max(20 * log10(p + 1e-9)), 6) AS max_level
FROM li GROUP BY bucket""")
def m12(spark, sf):
    inv = K.inventory(corpus(spark, sf).withColumn("lvl", F.lit(20.0) * F.log10(F.col("p") + 1e-9)), "bucket", "lvl")
    w = inline_table(spark, "bucket, weight", list(WEIGHTS.items()))
    return (inv.join(F.broadcast(w), "bucket", "left")
            .select("bucket", "n", r6("share_pct").alias("share_pct"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
                    r6("min_level").alias("min_level"), r6("max_level").alias("max_level")))


@query("m13_negative_kind_counts", f"""WITH {LI}, t AS (SELECT 'neg|' || content || '|' || recipe AS tag FROM li WHERE y = 0)
SELECT split_part(tag, '|', 2) AS kind, count(*) AS n FROM t WHERE starts_with(tag, 'neg|') GROUP BY kind""")
def m13(spark, sf):
    t = corpus(spark, sf).filter("y = 0").select(F.concat_ws("|", F.lit("neg"), "content", "recipe").alias("tag"))
    return K.kind_counts(t, "tag")


@query("m27_f1_over_grid", f"""WITH {LI}, g AS (SELECT unnest({_list(GRID20)}) AS threshold),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
      count(*) FILTER (y = 1) AS n_pos FROM li, g GROUP BY threshold),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, tp / n_pos AS rc FROM c)
SELECT threshold, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM d""")
def m27(spark, sf):
    t = M.with_f1(M.threshold_table(corpus(spark, sf), GRID20))
    return t.select("threshold", r6("precision").alias("precision"), r6("tpr").alias("recall"), r6("f1").alias("f1"))


@query("m28_class_weights", f"""WITH {LI}, c AS (SELECT greatest(1, count(*) FILTER (y = 1)) AS n_pos,
  greatest(1, count(*) FILTER (y = 0)) AS n_neg FROM li), r AS (SELECT *, n_neg / n_pos AS ratio FROM c)
SELECT n_pos, n_neg, round(ratio, 6) AS ratio, round(least(greatest(sqrt(ratio), 0.5), 2.0), 6) AS neg_w,
  round(1.15 * least(greatest(sqrt(ratio), 0.5), 2.0), 6) AS pos_w, round(least(2.5, 0.6 * ratio), 6) AS pos_w_capped,
  round(0.5 * ratio, 6) AS pos_w_half FROM r""")
def m28(spark, sf):
    w = M.class_weights(corpus(spark, sf))
    return w.select("n_pos", "n_neg", *[r6(c).alias(c) for c in ("ratio", "neg_w", "pos_w", "pos_w_capped", "pos_w_half")])


RUN_SQL = """, base AS (SELECT line AS run, count(*) AS n, count(DISTINCT part) AS params,
    avg((p >= 0.68)::INT) FILTER (y = 1) AS tpr, avg((p >= 0.68)::INT) FILTER (y = 0) AS fpr, avg(p) AS conf
  FROM li GROUP BY line)"""


@query("m29_recorded_vs_recomputed", f"""WITH {LI},
a AS (SELECT line, count(*) FILTER (y = 0) AS nn FROM li GROUP BY line),
ao AS (SELECT line, count(*) FILTER (y = 0) AS nn FROM li WHERE recipe = 'O' GROUP BY line),
ra AS (SELECT line, p, row_number() OVER (PARTITION BY line ORDER BY p DESC) AS rn FROM li WHERE y = 0),
ro AS (SELECT line, p, row_number() OVER (PARTITION BY line ORDER BY p DESC) AS rn FROM li WHERE y = 0 AND recipe = 'O')
SELECT a.line AS run, round(ro.p, 6) AS recorded, round(ra.p, 6) AS recomputed, abs(ro.p - ra.p) < 0.15 AS consistent
FROM a JOIN ao USING (line) JOIN ra ON ra.line = a.line AND ra.rn = floor(0.02 * a.nn)
JOIN ro ON ro.line = a.line AND ro.rn = floor(0.02 * ao.nn)""")
def m29(spark, sf):
    li = corpus(spark, sf)
    now = M.at_budgets(li, [0.02], ["line"]).select("line", F.col("threshold").alias("recomputed"))
    old = M.at_budgets(li.filter("recipe = 'O'"), [0.02], ["line"]).select("line", F.col("threshold").alias("recorded"))
    j = K.consistency(old, now, ["line"], "recorded", "recomputed", 0.15)
    return j.select(F.col("line").alias("run"), r6("recorded").alias("recorded"), r6("recomputed").alias("recomputed"), "consistent")


def _runs(spark, sf):
    """One row per training run: a registry derived from the corpus rows of each run."""
    li = corpus(spark, sf)
    hit = (F.col("p") >= 0.68).cast("int")
    return li.groupBy(F.col("line").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("params"),
        F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"),
        F.avg("p").alias("conf"))


@query("m30_run_registry_comparison", f"""WITH {LI}{RUN_SQL}
SELECT run, params, round(tpr, 6) AS tpr, round(tpr - lag(tpr) OVER (ORDER BY run), 6) AS tpr_delta,
  params - lag(params) OVER (ORDER BY run) AS params_delta, round(tpr - max(tpr) OVER (), 6) AS tpr_vs_best,
  arg_max(run, tpr) OVER () AS best_run FROM base""")
def m30(spark, sf):
    t = K.compare_runs(_runs(spark, sf), "run", ["tpr", "params"], "tpr")
    return t.select("run", "params", r6("tpr").alias("tpr"), r6("tpr_delta").alias("tpr_delta"), "params_delta",
                    r6("tpr_vs_best").alias("tpr_vs_best"), "best_run")


@query("m31_false_alarms_per_thousand", f"""WITH {LI}
SELECT bucket, count(*) FILTER (p >= {THR}) AS fa, CAST(round_even(1000.0 * count(*) FILTER (p >= {THR}) / count(*), 0) AS BIGINT) AS fa_per_k
FROM li WHERE y = 0 GROUP BY bucket""")
def m31(spark, sf):
    g = corpus(spark, sf).filter("y = 0").groupBy("bucket").agg(
        F.count_if(F.col("p") >= THR).alias("fa"), F.count(F.lit(1)).alias("n"))
    return g.select("bucket", "fa", F.bround(1000.0 * F.col("fa") / F.col("n")).cast("bigint").alias("fa_per_k"))


# ---- K: ranking -------------------------------------------------------------------------------

@query("k1_top_by_score", f"""WITH {LI} SELECT row_key, round(p, 6) AS p FROM li WHERE y = 0 ORDER BY q DESC, row_key LIMIT 6000""")
def k1(spark, sf):
    return K.top_n(corpus(spark, sf).filter("y = 0"), "p", ["row_key"], 6000).select("row_key", r6("p").alias("p"))


@query("k2_bottom_by_score", f"""WITH {LI} SELECT row_key, round(p, 6) AS p FROM li WHERE y = 1 ORDER BY q, row_key LIMIT 8000""")
def k2(spark, sf):
    return K.top_n(corpus(spark, sf).filter("y = 1"), "p", ["row_key"], 8000, worst=True).select("row_key", r6("p").alias("p"))


@query("k5_grid_arg_max", f"""WITH {LI}, g AS (SELECT unnest({_list(GRID20)}) AS threshold),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) / count(*) FILTER (y = 1) AS tpr,
      count(*) FILTER (y = 0 AND p >= threshold) / count(*) FILTER (y = 0) AS fpr FROM li, g GROUP BY threshold)
SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c WHERE fpr <= 0.2 ORDER BY tpr DESC, threshold LIMIT 1""")
def k5(spark, sf):
    t = M.threshold_table(corpus(spark, sf), GRID20)
    return K.best_within(t, "tpr", F.col("fpr") <= 0.2, ["threshold"]).select(
        "threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


EPOCHS = 40
EPOCH_SQL = f""", ep AS (SELECT part % {EPOCHS} AS epoch, avg((p >= 0.68)::INT) FILTER (y = 1) AS tpr,
  avg((p >= 0.68)::INT) FILTER (y = 0) AS fpr, avg((y = (p >= 0.68)::INT)::INT) AS acc FROM li GROUP BY epoch)"""


def _history(spark, sf):
    """A 40-epoch training history derived from the corpus."""
    li = corpus(spark, sf)
    hit = (F.col("p") >= 0.68).cast("int")
    return li.groupBy((F.col("part") % EPOCHS).alias("epoch")).agg(
        F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"),
        F.avg((F.col("y") == hit).cast("int")).alias("acc"))


@query("k6_best_epoch_running_margin", f"""WITH RECURSIVE {LI}{EPOCH_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY epoch) AS rn FROM ep),
w(rn, epoch, best, saved) AS (SELECT 0::BIGINT, -1::BIGINT, -1.0::DOUBLE, false
  UNION ALL SELECT o.rn, o.epoch, CASE WHEN o.tpr > w.best + 1e-6 AND o.epoch >= 3 THEN o.tpr ELSE w.best END,
    o.tpr > w.best + 1e-6 AND o.epoch >= 3 FROM w JOIN o ON o.rn = w.rn + 1)
SELECT epoch, round(best, 6) AS best FROM w WHERE saved""")
def k6a(spark, sf):
    t = K.saved_epochs(_history(spark, sf), "epoch", "tpr", margin=1e-6, warmup=3)
    return t.select("epoch", r6("best").alias("best"))


@query("k6_best_epoch_auc_or_fpr_rule", f"""WITH RECURSIVE {LI}{EPOCH_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY epoch) AS rn FROM ep),
w(rn, epoch, ba, bf, saved) AS (SELECT 0::BIGINT, -1::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, false
  UNION ALL SELECT rn, epoch, CASE WHEN s THEN acc ELSE ba END, CASE WHEN s THEN fpr ELSE bf END, s
  FROM (SELECT o.*, w.ba, w.bf, (o.epoch < 15 OR o.tpr >= 0.2) AND (o.acc > w.ba OR (o.acc >= w.ba - 0.005 AND o.fpr < w.bf)) AND o.epoch >= 10 AS s
        FROM w JOIN o ON o.rn = w.rn + 1))
SELECT epoch, round(ba, 6) AS score, round(bf, 6) AS fpr FROM w WHERE saved""")
def k6b(spark, sf):
    t = K.saved_epochs_rule(_history(spark, sf), "epoch", "acc", "fpr", "tpr", slack=0.005, start=10, floor_after=15, floor=0.2)
    return t.select("epoch", r6("score").alias("score"), r6("fpr").alias("fpr"))


CFG_SQL = """, cf AS (SELECT supp AS cfg, count(*) AS mac, count(DISTINCT part) AS params, max(line) AS width FROM li GROUP BY supp)"""


def _configs(spark, sf):
    """Candidate model configurations with a capacity and a cost, one per supplier."""
    return corpus(spark, sf).groupBy(F.col("supp").alias("cfg")).agg(
        F.count(F.lit(1)).alias("mac"), F.countDistinct("part").alias("params"), F.max("line").alias("width"))


@query("p12_budget_verdict", f"""WITH {LI}{CFG_SQL}
SELECT cfg, mac, params, CASE WHEN mac <= (SELECT avg(mac) FROM cf) THEN 'PASS' ELSE 'over' END AS verdict FROM cf""")
def p12(spark, sf):
    c = _configs(spark, sf)
    cap = c.agg(F.avg("mac")).scalar()
    return c.select("cfg", "mac", "params", F.when(F.col("mac") <= cap, "PASS").otherwise("over").alias("verdict"))


@query("k7_multi_key_ranking", f"""WITH {LI}{CFG_SQL}
SELECT 'capacity' AS list, cfg, params, mac, rn AS rank FROM (SELECT *, row_number() OVER (ORDER BY params DESC, mac, cfg) AS rn FROM cf) WHERE rn <= 18
UNION ALL SELECT 'proxy', cfg, params, mac, rn FROM (SELECT *, row_number() OVER (ORDER BY round(sqrt(params) / pow(mac, 0.25), 9) DESC, cfg) AS rn FROM cf) WHERE rn <= 16
UNION ALL SELECT 'widest', cfg, params, mac, rn FROM (SELECT *, row_number() OVER (ORDER BY params DESC, cfg) AS rn FROM cf) WHERE rn <= 8""")
def k7(spark, sf):
    return K.config_rankings(_configs(spark, sf))


@query("k8_dominating_configs", f"""WITH {LI}{CFG_SQL}
SELECT cfg, params, mac FROM cf a WHERE NOT EXISTS (SELECT 1 FROM cf b WHERE b.params >= a.params AND b.mac <= a.mac
  AND (b.params > a.params OR b.mac < a.mac))""")
def k8(spark, sf):
    return K.non_dominated(_configs(spark, sf), better_high="params", better_low="mac").select("cfg", "params", "mac")


@query("k8_verdict_against_reference", f"""WITH {LI}{CFG_SQL}, ref AS (SELECT avg(params) AS rp, avg(mac) AS rm FROM cf)
SELECT cfg, CASE WHEN params > rp AND mac < rm THEN 'PASS' ELSE 'over' END AS verdict FROM cf, ref""")
def k8b(spark, sf):
    c = _configs(spark, sf)
    return c.select("cfg", F.when(
        (F.col("params") > c.agg(F.avg("params")).scalar()) & (F.col("mac") < c.agg(F.avg("mac")).scalar()),
        "PASS").otherwise("over").alias("verdict"))


def _loss_sql(kind: str) -> str:
    return f"""WITH {LI}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '7', 'epoch', row_key)), row_key) - 1 AS pos FROM li),
b AS (SELECT *, pos // 256 AS batch, -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END) AS loss FROM o WHERE pos < (SELECT count(*) // 256 * 256 FROM li))
{kind}"""


@query("k12_batch_assignment", _loss_sql("SELECT batch, count(*) AS n, sum(y)::BIGINT AS n_pos, round(sum(loss), 6) AS loss FROM b GROUP BY batch"))
def k12(spark, sf):
    b = K.batches(corpus(spark, sf, dealt=True), ["row_key"], 256, seed=7, salt="epoch", drop_last=True)
    loss = -F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return b.withColumn("loss", loss).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), r6(F.sum("loss")).alias("loss"))


@query("k11_hardest_negatives_in_batch", _loss_sql("""SELECT batch, count(*) AS kept, count(*) FILTER (y = 0) AS kept_neg, round(min(loss) FILTER (y = 0), 6) AS min_neg_loss
FROM (SELECT *, row_number() OVER (PARTITION BY batch, y ORDER BY loss DESC, row_key) AS rn FROM b) WHERE y = 1 OR rn <= 64 GROUP BY batch"""))
def k11(spark, sf):
    b = K.batches(corpus(spark, sf, dealt=True), ["row_key"], 256, seed=7, salt="epoch", drop_last=True)
    loss = -F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))
    kept = K.hardest_negatives(b.withColumn("loss", loss), "batch", "loss", ["row_key"], 64)
    return kept.groupBy("batch").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(F.col("y") == 0).alias("kept_neg"),
        r6(F.min(F.when(F.col("y") == 0, F.col("loss")))).alias("min_neg_loss"))
