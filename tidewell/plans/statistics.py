"""ST and the evaluation aggregates: scores against labels, agreement, thresholds, bootstraps, components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import stats as T
from tidewell.sources.views import CLAIMS, GOLD, claims, gold, table

c = F.col
W = f"WITH {GOLD}"
AUC = "(SELECT {k}, sum(won) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT {k}, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM (SELECT {k}, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM gold GROUP BY ALL)) GROUP BY {k})"


@query("st01_auc", f"{W}, k AS (SELECT * FROM gold) SELECT lang, round(auc, 6) AS auc FROM {AUC.format(k='lang')}")
def st01(spark, d):
    return T.auc(gold(spark, d), "lang").select("lang", F.round("auc", 6).alias("auc"))


@query("st02_brier", f"{W} SELECT lang, round(avg(pow(p - y, 2)), 8) AS brier FROM gold GROUP BY 1")
def st02(spark, d):
    return gold(spark, d).groupBy("lang").agg(F.round(F.avg(F.pow(c("p") - c("y"), 2)), 8).alias("brier"))


@query("st03_logistic_baseline")
def st03(spark, d):
    """A logistic model on standardised features and its log loss by language."""
    from tidewell.operators.learning import logistic

    df = gold(spark, d).withColumns({"f1": c("p"), "f2": F.sin(c("id").cast("double"))})
    scored = logistic(df, ["f1", "f2"], "y")
    q = F.greatest(F.least("probability", F.lit(1 - 1e-9)), F.lit(1e-9))
    return scored.groupBy("lang").agg(F.round(F.avg(-c("y") * F.ln(q) - (1 - c("y")) * F.ln(1 - q)), 4).alias("log_loss"))


@query("st04_day_bootstrap")
def st04(spark, d):
    return T.bootstrap_auc_difference(gold(spark, d).withColumn("q", c("p") * 0.5 + (c("id") % 10) / 20), "day", "p", "q")


@query("st05_cluster_bootstrap")
def st05(spark, d):
    return T.bootstrap_mean(gold(spark, d), "cluster", "lang", "y")


@query("st06_kappa", f"""{W}, l AS (SELECT *, (p >= 0.5)::INT AS a FROM gold), t AS (SELECT lang, count(*) AS n, avg((a = y)::INT) AS po, avg(a) AS pa, avg(y) AS py FROM l GROUP BY 1)
SELECT lang, round((po - (pa * py + (1 - pa) * (1 - py))) / nullif(1 - (pa * py + (1 - pa) * (1 - py)), 0), 6) AS kappa FROM t""")
def st06(spark, d):
    return T.kappa(gold(spark, d).withColumn("a", (c("p") >= 0.5).cast("int")), "a", "y", "lang").select("lang", F.round("kappa", 6).alias("kappa"))


@query("st07_upper_bound")
def st07(spark, d):
    n = gold(spark, d).groupBy("cluster").agg(F.count_if(c("y") == 0).alias("hits"), F.count("*").alias("n"))
    return n.withColumn("bound", F.round(T.upper_bound(c("hits"), c("n")), 6))


@query("st08_detectable_effect")
def st08(spark, d):
    return T.bootstrap_mean(gold(spark, d), "cluster", None, "y").select((2.8 * c("se")).alias("mde"))


@query("st09_verdict", f"{W}, g AS (SELECT cluster, avg(p - 0.5) - 0.05 AS low, avg(p - 0.5) + 0.05 AS high FROM gold GROUP BY 1) SELECT cluster, CASE WHEN low > 0 THEN 'superior' WHEN low >= -0.1 AND high <= 0.1 THEN 'equivalent' WHEN high < 0 THEN 'inferior' ELSE 'open' END AS verdict FROM g")
def st09(spark, d):
    g = gold(spark, d).groupBy("cluster").agg((F.avg(c("p") - 0.5) - 0.05).alias("low"), (F.avg(c("p") - 0.5) + 0.05).alias("high"))
    return g.select("cluster", T.verdict(c("low"), c("high"), 0.1).alias("verdict"))


@query("st10_macro_f1", f"{W}, l AS (SELECT y, (p >= 0.5)::INT AS a FROM gold), k AS (SELECT v, 2.0 * count(*) FILTER (a = v AND y = v) / (count(*) FILTER (a = v) + count(*) FILTER (y = v)) AS f FROM l, (VALUES (0), (1)) t(v) GROUP BY 1) SELECT round(avg(f), 6) AS macro_f1 FROM k")
def st10(spark, d):
    return T.macro_f1(gold(spark, d).withColumn("a", (c("p") >= 0.5).cast("int")), "y", "a").select(F.round("macro_f1", 6).alias("macro_f1"))


SWEEP = """g AS (SELECT i, i / 100.0::DOUBLE AS threshold FROM range(0, 101) r(i)), cells AS (SELECT least(floor(round(p * 100, 9)), 100)::BIGINT AS k, y FROM gold),
sw AS (SELECT threshold, count(k) AS n, coalesce(sum(y), 0)::BIGINT AS hits, (SELECT sum(y) FROM gold)::BIGINT AS allp FROM g LEFT JOIN cells ON k >= i GROUP BY 1),
sw2 AS (SELECT threshold, n, hits, hits / nullif(n, 0) AS precision, hits / nullif(allp, 0) AS recall, coalesce(2.0::DOUBLE * hits / nullif(n + allp, 0), 0) AS f1 FROM sw)"""


@query("st11_threshold_sweep", f"{W}, {SWEEP} SELECT threshold, n, hits, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM sw2")
def st11(spark, d):
    s = T.sweep(gold(spark, d))
    return s.select("threshold", "n", "hits", *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")])


@query("st11_best_thresholds", f"{W}, {SWEEP} SELECT arg_max(threshold, row(round(f1, 9), threshold)) AS by_f1, coalesce(min(threshold) FILTER (precision >= 0.9::DOUBLE), arg_max(threshold, row(round(f1, 9), threshold))) AS by_precision FROM sw2")
def st11b(spark, d):
    s = T.sweep(gold(spark, d))
    return T.best_f1(s).select(c("threshold").alias("by_f1")).crossJoin(T.precise_enough(s, 0.9).select(c("threshold").alias("by_precision")))


@query("st12_counted_threshold", f"{W}, {SWEEP} SELECT coalesce(min(threshold) FILTER (precision >= 0.93::DOUBLE AND n >= 30), arg_max(threshold, row(round(f1, 9), threshold))) AS threshold FROM sw2")
def st12(spark, d):
    return T.precise_enough(T.sweep(gold(spark, d)), 0.93, 30)


@query("st13_band_thresholds", f"{W}, {SWEEP}, z AS (SELECT threshold, (SELECT count(*) FROM gold) - n AS below, (SELECT sum(y) FROM gold)::BIGINT - hits AS below_hits, precision FROM sw2) SELECT max(threshold) FILTER (below > 0 AND below_hits / below <= 0.9::DOUBLE) AS low, min(threshold) FILTER (precision >= 0.95::DOUBLE) AS high FROM z")
def st13(spark, d):
    """The largest threshold below which at most 90 % are positive, and the smallest above which 95 % are."""
    s = T.sweep(gold(spark, d))
    total = gold(spark, d).agg(F.count("*").alias("alln"), F.sum("y").alias("ally"))
    z = s.crossJoin(F.broadcast(total)).withColumns({"below": c("alln") - c("n"), "below_hits": c("ally") - c("hits")})
    return z.agg(F.max(F.when((c("below") > 0) & (F.try_divide("below_hits", "below") <= 0.9), c("threshold"))).alias("low"), F.min(F.when(c("precision") >= 0.95, c("threshold"))).alias("high"))


@query("st14_rates", f"{W} SELECT lang, round(sum(y * (p >= 0.6)::INT) / nullif(sum((p >= 0.6)::INT), 0), 6) AS precision, round(sum(y * (p >= 0.6)::INT) / nullif(sum(y), 0), 6) AS recall, round(avg((p BETWEEN 0.4 AND 0.6)::INT), 6) AS boundary, round(1 - avg((p BETWEEN 0.4 AND 0.6)::INT), 6) AS call_reduction FROM gold GROUP BY 1")
def st14(spark, d):
    yes, edge = (c("p") >= 0.6).cast("int"), c("p").between(0.4, 0.6).cast("int")
    return gold(spark, d).groupBy("lang").agg(F.round(F.try_divide(F.sum(c("y") * yes), F.sum(yes)), 6).alias("precision"), F.round(F.try_divide(F.sum(c("y") * yes), F.sum("y")), 6).alias("recall"), F.round(F.avg(edge), 6).alias("boundary"), F.round(1 - F.avg(edge), 6).alias("call_reduction"))


@query("st15_gate_evaluation")
def st15(spark, d):
    """Precision at a threshold with its cluster interval, and whether each gate passes."""
    kept = gold(spark, d).where("p >= 0.5")
    ci = T.bootstrap_mean(kept, "cluster", None, "y")
    return kept.agg(F.avg("y").alias("precision"), F.count("*").alias("n")).crossJoin(ci.select("low", "high")).withColumns({"precise": c("precision") >= 0.8, "sure": c("low") >= 0.75, "enough": c("n") >= 30})


@query("st16_grid_choice", f"{W}, e AS (SELECT s.sig, t.tau, avg(((CASE s.sig WHEN 'p' THEN p ELSE 1 - p END >= t.tau)::INT = y)::INT) AS acc, avg((CASE s.sig WHEN 'p' THEN p ELSE 1 - p END < t.tau AND y = 1)::INT) AS lost FROM gold, (VALUES ('p'), ('q')) s(sig), (VALUES (0.3::DOUBLE), (0.5), (0.7)) t(tau) GROUP BY ALL) SELECT sig, tau, round(acc, 6) AS acc, round(lost, 6) AS lost, row_number() OVER (ORDER BY round(acc, 6) DESC, round(lost, 6), tau, sig)::INT AS place FROM e")
def st16(spark, d):
    """Every signal and threshold of a small grid at once: conditional means, then a lexicographic order."""
    signals = {"p": c("p"), "q": 1 - c("p")}
    cells = [(s, t) for s in signals for t in (0.3, 0.5, 0.7)]
    aggs = [F.struct(F.lit(s).alias("sig"), F.lit(t).alias("tau"), F.round(F.avg(((signals[s] >= t).cast("int") == c("y")).cast("int")), 6).alias("acc"), F.round(F.avg(((signals[s] < t) & (c("y") == 1)).cast("int")), 6).alias("lost")) for s, t in cells]
    rows = gold(spark, d).agg(F.array(*aggs).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("acc"), "lost", "tau", "sig")))


@query("st17_label_merge", f"{W}, r AS (SELECT id, y AS one, CASE WHEN id % 6 = 0 THEN 1 - y ELSE y END AS two, CASE WHEN id % 12 = 0 THEN y END AS judge FROM gold) SELECT id, one = two AS agreed, CASE WHEN one = two THEN one ELSE coalesce(judge, -1) END AS label FROM r")
def st17(spark, d):
    g = gold(spark, d)
    votes = g.select("id", F.lit("one").alias("who"), c("y").alias("v")).union(g.select("id", F.lit("two"), F.when(c("id") % 6 == 0, 1 - c("y")).otherwise(c("y")))).union(g.where("id % 12 = 0").select("id", F.lit("judge"), "y"))
    wide = votes.groupBy("id").agg(*[F.max(F.when(c("who") == w, c("v"))).alias(w) for w in ("one", "two", "judge")])
    same = c("one") == c("two")
    return wide.select("id", same.alias("agreed"), F.when(same, c("one")).otherwise(F.coalesce("judge", F.lit(-1))).alias("label"))


@query("st18_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 50")
def st18(spark, d):
    """A sampling operator: the first 50 in hash order."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.sha2(c("doc_id").cast("string"), 256)).limit(50)


@query("st19_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 997 AS a, l_partkey % 991 + 2000 AS b FROM lineitem WHERE l_quantity = 1 AND l_discount = 0),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y) SELECT x AS node, min(y) AS component FROM r GROUP BY 1""")
def st19(spark, d):
    e = table(spark, d, "lineitem").where("l_quantity = 1 and l_discount = 0").select((c("l_orderkey") % 997).alias("a"), (c("l_partkey") % 991 + 2000).alias("b"))
    return T.components(e)


@query("st21_cost_summary", f"WITH {CLAIMS} SELECT route, count(*) AS calls, sum(latency_ms * 3)::BIGINT AS tokens, round(sum(latency_ms * 3) / 1e6 * 0.15, 6) AS cost FROM claims GROUP BY 1")
def st21(spark, d):
    return claims(spark, d).groupBy("route").agg(F.count("*").alias("calls"), F.sum(c("latency_ms") * 3).alias("tokens"), F.round(F.sum(c("latency_ms") * 3) / 1e6 * 0.15, 6).alias("cost"))


@query("agg15_calibration", f"{W}, b AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, * FROM gold) SELECT r.bin, count(b.id) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY 1")
def agg15(spark, d):
    return T.calibration(gold(spark, d)).withColumns({"mean_p": F.round("mean_p", 6), "rate": F.round("rate", 6)})


@query("agg17_call_summary", f"WITH {CLAIMS} SELECT quantile_cont(latency_ms, 0.5)::DOUBLE AS p50, quantile_cont(latency_ms, 0.95)::DOUBLE AS p95, quantile_cont(latency_ms, 0.99)::DOUBLE AS p99, round(avg((status = 'contradicted')::INT), 6) AS failed, round(avg(CASE WHEN status <> 'contradicted' THEN (route = 'judge')::INT END), 6) AS valid, count(DISTINCT route) AS models FROM claims")
def agg17(spark, d):
    bad = c("status") == "contradicted"
    return claims(spark, d).agg(*[F.percentile("latency_ms", p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.round(F.avg(bad.cast("int")), 6).alias("failed"), F.round(F.avg(F.when(~bad, (c("route") == "judge").cast("int"))), 6).alias("valid"), F.count_distinct("route").alias("models"))


@query("agg18_repeat_agreement", f"WITH {CLAIMS}, v AS (SELECT part, count(*) AS n, max(k) AS top, any_value(sd) AS sd FROM (SELECT part, status, count(*) OVER (PARTITION BY part, status) AS k, stddev_pop(s) OVER (PARTITION BY part) AS sd FROM claims) GROUP BY 1) SELECT round(sum(CASE WHEN 2 * top > n THEN top ELSE 0 END) / sum(n), 6) AS agreement, round(avg(sd), 6) AS mean_std FROM v")
def agg18(spark, d):
    """Share of repeats equal to their item's strict majority, and the mean deviation of scores."""
    by = claims(spark, d).groupBy("part", "status").agg(F.count("*").alias("k"), F.sum("s").alias("s1"), F.sum(c("s") * c("s")).alias("s2"))
    item = by.groupBy("part").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    sd = F.sqrt(F.greatest(c("s2") / c("n") - F.pow(c("s1") / c("n"), 2), F.lit(0.0)))
    return item.agg(F.round(F.sum(F.when(2 * c("top") > c("n"), c("top")).otherwise(0)) / F.sum("n"), 6).alias("agreement"), F.round(F.avg(sd), 6).alias("mean_std"))
