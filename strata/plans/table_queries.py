"""Registered queries over the relational tables: splits, exclusion, tables of counts, calibration, resampling, episodes, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions.sampling import hash_key, hash_uniform
from strata.operators import labels, metrics

from .registry import register, table

_HALF = "substr(md5(CAST({} AS {})), 1, 1) < '8'"


@register("exact_duplicates", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("label_conflicts", "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)")
def label_conflicts(spark, sf_dir):
    return labels.conflicting(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", F.md5("text"), "source")


@register("exclusion_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclusion_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@register("inclusion_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def inclusion_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register("lookup_fill", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_fill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").na.fill(0, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@register("equi_join_region", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def equi_join_region(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@register("rank_in_region", "SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name DESC) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def rank_in_region(spark, sf_dir):
    return equi_join_region(spark, sf_dir).select("r_name", "n_name", F.row_number().over(Window.partitionBy("r_name").orderBy(F.desc("n_name"))).cast("long").alias("place"))


@register("left_closed_bins", "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 1000 THEN 0 WHEN o_totalprice >= 1000 AND o_totalprice < 50000 THEN 1 WHEN o_totalprice >= 50000 AND o_totalprice < 1e9 THEN 2 END AS bin, count(*) AS n FROM orders GROUP BY 1")
def left_closed_bins(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(labels.left_closed_bins(F.col("o_totalprice"), [0, 1000, 50000, 1e9]).alias("bin")).agg(F.count("*").alias("n"))


@register("zero_filled_counts", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS n FROM nation")
def zero_filled_counts(spark, sf_dir):
    return labels.zero_filled_counts(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), table(spark, sf_dir, "nation"), "n_nationkey")


@register("codes_by_first", "SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY c_mktsegment")
def codes_by_first(spark, sf_dir):
    return labels.codes_by_first(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@register("pivot_counts", "SELECT lang, count_if(source = 'src0') AS src0, count_if(source = 'src1') AS src1, count_if(source = 'src2') AS src2 FROM documents GROUP BY lang")
def pivot_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().na.fill(0, ["src0", "src1", "src2"])


@register("contingency_table", "SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def contingency_table(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@register("agreement_ari_nmi", """WITH C AS (SELECT l_returnflag AS y, l_linestatus AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), R AS (SELECT sum(n) AS n FROM C GROUP BY y), K AS (SELECT sum(n) AS n FROM C GROUP BY c),
S AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM C) AS p, (SELECT sum(n * (n - 1) / 2) FROM R) AS py, (SELECT sum(n * (n - 1) / 2) FROM K) AS pc, (SELECT sum(n) FROM C) AS t,
 (SELECT sum(n * ln(n)) FROM C) AS h, (SELECT sum(n * ln(n)) FROM R) AS hy, (SELECT sum(n * ln(n)) FROM K) AS hc)
SELECT round((p - py * pc / (t * (t - 1) / 2)) / ((py + pc) / 2 - py * pc / (t * (t - 1) / 2)), 6) AS ari, round(((ln(t) - hy / t) + (ln(t) - hc / t) - (ln(t) - h / t)) / (((ln(t) - hy / t) + (ln(t) - hc / t)) / 2), 6) AS nmi FROM S""")  # fmt: skip
def agreement_ari_nmi(spark, sf_dir):
    return metrics.agreement(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


_GAP = _HALF.format("c_custkey", "VARCHAR")


@register("prevalence_tv_kl", f"""WITH H AS (SELECT n_nationkey, count_if({_GAP}) AS p, count(c_custkey) - count_if({_GAP}) AS q FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
T AS (SELECT sum(p) AS tp, sum(q) AS tq, count(*) AS k FROM H)
SELECT round(sum(abs(p / tp - q / tq)) / 2, 6) AS tv, round(sum((p + 1) / (tp + k) * ln((p + 1) / (tp + k) / ((q + 1) / (tq + k)))), 6) AS kl FROM H, T""")  # fmt: skip
def prevalence_tv_kl(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    gap = metrics.prevalence_gap(customers, table(spark, sf_dir, "nation"), "n_nationkey", F.expr(_HALF.format("c_custkey", "STRING")))
    return gap.select(F.round("tv", 6).alias("tv"), F.round("kl", 6).alias("kl"))


@register("rare_classes", "WITH C AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_nationkey, n, n <= (SELECT quantile_cont(n, 0.25) FROM C) AS rare FROM C")
def rare_classes(spark, sf_dir):
    counts = labels.zero_filled_counts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")), table(spark, sf_dir, "nation"), "n_nationkey")
    return counts.crossJoin(F.broadcast(counts.agg(F.percentile("n", F.lit(0.25)).alias("q")))).select("n_nationkey", "n", (F.col("n") <= F.col("q")).alias("rare"))  # one row


_CONF = "SELECT least(round(n_chars / 4000.0, 2), 1.0) AS conf, quality = 1 AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _confidence(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(F.least(F.round(F.col("n_chars") / 4000.0, 2), F.lit(1.0)).cast("double").alias("conf"), (F.col("quality") == 1).alias("good"))


@register("choose_tau", f"WITH C AS ({_CONF}), S AS (SELECT conf, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) OVER (ORDER BY conf DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM C) SELECT coalesce(min(conf), 1.0)::DOUBLE AS tau FROM S WHERE share >= 0.88")
def choose_tau(spark, sf_dir):
    return metrics.choose_threshold(_confidence(spark, sf_dir), "conf", "good", 0.88)


@register("calibration_ece", f"WITH C AS ({_CONF}), B AS (SELECT ceil(conf * 15) AS bin, count(*) AS n, abs(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) - avg(conf)) AS gap FROM C WHERE conf > 0 GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM B")
def calibration_ece(spark, sf_dir):
    return metrics.calibration_error(_confidence(spark, sf_dir), "conf", "good").select(F.round("ece", 6).alias("ece"))


@register("bootstrap_intervals", """WITH R AS (SELECT l.doc_id, lang, quality::DOUBLE AS v, row_number() OVER (PARTITION BY lang ORDER BY l.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
D AS (SELECT lang, b, ('0x' || substr(md5('7:' || b || ':' || lang || ':' || pos), 1, 8))::BIGINT % size AS pos FROM R, range(50) t(b)),
M AS (SELECT D.lang, b, avg(v) AS m FROM D JOIN R ON D.lang = R.lang AND D.pos = R.pos GROUP BY ALL), A AS (SELECT b, avg(m) AS m FROM M GROUP BY b), P AS (SELECT lang, avg(v) AS mean, count(*) AS n FROM R GROUP BY lang)
SELECT P.lang AS "group", round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM P JOIN (SELECT lang, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM M GROUP BY lang) Q ON P.lang = Q.lang
UNION ALL SELECT 'macro', round((SELECT avg(mean) FROM P), 6), round(quantile_cont(m, 0.025), 6), round(quantile_cont(m, 0.975), 6), (SELECT count(*) FROM P) FROM A""")  # fmt: skip
def bootstrap_intervals(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").cast("double").alias("v"))
    return metrics.bootstrap(joined, "lang", "doc_id", "v", 50, 7).select("group", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n")


@register("subsample", "WITH R AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM R WHERE place <= greatest(2, round_even(n * 0.6, 0))")
def subsample(spark, sf_dir):
    split = labels.stratified_split(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 0.6, 3, ("in", "out"))
    return split.where("split = 'in'").select("c_custkey", "c_mktsegment")


@register("control_weights", """WITH F AS (SELECT n_regionkey AS coarse, n_nationkey AS fine, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT coarse, fine, round(n / sum(n) OVER (PARTITION BY coarse), 6) AS prevalence, round(1.0 / count(*) OVER (PARTITION BY coarse), 6)::DOUBLE AS uniform,
 CASE WHEN row_number() OVER (PARTITION BY coarse ORDER BY n DESC, fine) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS majority FROM F""")  # fmt: skip
def control_weights(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    counts = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").alias("coarse"), F.col("n_nationkey").alias("fine")).agg(F.count("c_custkey").alias("n"))
    own = Window.partitionBy("coarse")
    first = F.row_number().over(own.orderBy(F.desc("n"), "fine")) == 1
    return counts.select("coarse", "fine", F.round(F.try_divide(F.col("n"), F.sum("n").over(own)), 6).alias("prevalence"), F.round(1.0 / F.count("*").over(own), 6).alias("uniform"), F.when(first, 1.0).otherwise(0.0).alias("majority"))


@register("control_draws", """WITH C AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1), U AS (SELECT k, (sum(n) OVER (ORDER BY k) - n) / (SELECT sum(n) FROM C) AS low, sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM C) AS high FROM C)
SELECT c_custkey, k AS drawn FROM customer JOIN U ON ('0x' || substr(md5('5:' || c_custkey), 1, 8))::BIGINT / 4294967296.0 >= low AND ('0x' || substr(md5('5:' || c_custkey), 1, 8))::BIGINT / 4294967296.0 < high""")  # fmt: skip
def control_draws(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = counts.agg(F.sum("n").alias("t"))
    edges = counts.withColumn("c", F.sum("n").over(upto)).crossJoin(F.broadcast(whole)).select("k", ((F.col("c") - F.col("n")) / F.col("t")).alias("low"), (F.col("c") / F.col("t")).alias("high"))
    table_of = edges.agg(F.collect_list(F.struct("low", "high", "k")).alias("edges"))  # one row, as long as there are classes
    drawn = table(spark, sf_dir, "customer").select("c_custkey", hash_uniform(F.lit(5), F.col("c_custkey")).alias("u")).crossJoin(F.broadcast(table_of))
    return drawn.select("c_custkey", F.filter("edges", lambda e: (F.col("u") >= e["low"]) & (F.col("u") < e["high"]))[0]["k"].alias("drawn"))


_POOL = "SELECT n_nationkey AS fine, n_regionkey AS coarse, c_custkey AS id, row_number() OVER (PARTITION BY n_nationkey ORDER BY md5('11:' || k || ':' || c_custkey), c_custkey) AS place, count(*) OVER (PARTITION BY n_nationkey) AS n, k FROM nation JOIN customer ON c_nationkey = n_nationkey, (VALUES (1), (5), (10)) K(k)"


@register("single_class_episodes", f"WITH P AS ({_POOL.replace('PARTITION BY n_nationkey', 'PARTITION BY n_nationkey, k')}) SELECT k::INT AS k, fine, string_agg(id::VARCHAR, ' ' ORDER BY id) FILTER (place <= k) AS support, count(*) - k AS n_target FROM P WHERE n >= k + 10 GROUP BY k, fine")
def single_class_episodes(spark, sf_dir):
    pools = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("fine"), F.col("c_custkey").alias("id")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    order = Window.partitionBy("k", "fine").orderBy(hash_key(F.lit(11), F.col("k"), F.col("id")), "id")
    placed = pools.withColumn("place", F.row_number().over(order))
    chosen = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= F.col("k"), F.col("id")))), lambda x: x.cast("string"))
    found = placed.groupBy("k", "fine").agg(F.array_join(chosen, " ").alias("support"), (F.count("*") - F.col("k")).alias("n_target"))
    return found.where("n_target >= 10")


@register("mixed_episode_pairs", """WITH P AS (SELECT a.n_regionkey AS coarse, a.n_nationkey AS a, b.n_nationkey AS b, row_number() OVER (PARTITION BY a.n_regionkey ORDER BY md5('13:' || a.n_nationkey || ':' || b.n_nationkey)) AS place
 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) SELECT coarse, a, b, round_even(r * 5, 0)::INT AS n_a, 5 - round_even(r * 5, 0)::INT AS n_b FROM P, (VALUES (0.5), (0.7), (0.9)) R(r) WHERE place <= 3""")  # fmt: skip
def mixed_episode_pairs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_regionkey").alias("coarse"), F.col("n_nationkey").alias("a")), nation.select(F.col("n_regionkey").alias("coarse"), F.col("n_nationkey").alias("b"))
    order = Window.partitionBy("coarse").orderBy(hash_key(F.lit(13), F.col("a"), F.col("b")))
    pairs = a.join(b, "coarse").where("a < b").withColumn("place", F.row_number().over(order)).where("place <= 3")
    n_a = F.bround(F.col("r") * 5, 0).cast("int")
    return pairs.withColumn("r", F.explode(F.expr("array(0.5, 0.7, 0.9)"))).select("coarse", "a", "b", n_a.alias("n_a"), (5 - n_a).alias("n_b"))


@register("verdict_table", """WITH M AS (SELECT l_returnflag AS control, l_linestatus AS metric, avg(l_discount) AS mean, avg(l_discount) - 0.0002 AS lo, avg(l_discount) + 0.0002 AS hi FROM lineitem GROUP BY ALL), B AS (SELECT avg(l_discount) AS mean, avg(l_discount) - 0.0001 AS lo, avg(l_discount) + 0.0001 AS hi FROM lineitem)
SELECT control, metric, CASE WHEN M.lo > B.hi AND control = 'R' THEN 'ok' WHEN control = 'R' THEN 'MISSED' WHEN M.lo > B.hi THEN 'also' ELSE 'same' END AS verdict FROM M, B""")  # fmt: skip
def verdict_table(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    around = lambda w: F.struct(F.avg("l_discount").alias("mean"), (F.avg("l_discount") - w).alias("lo"), (F.avg("l_discount") + w).alias("hi"))
    groups = items.groupBy(F.col("l_returnflag").alias("control"), F.col("l_linestatus").alias("metric")).agg(around(0.0002).alias("v"))
    both = groups.crossJoin(F.broadcast(items.agg(around(0.0001).alias("b"))))  # one row
    return both.select("control", "metric", metrics.verdict(metrics.worse_than("v", "b", F.lit(True), 0.1), F.col("control") == "R").alias("verdict"))


@register("two_level_mean", "WITH C AS (SELECT n_regionkey, c_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), G AS (SELECT n_regionkey::VARCHAR AS \"group\", avg(m) AS mean, count(*) AS n FROM C GROUP BY n_regionkey) SELECT \"group\", round(mean, 4) AS mean, n FROM G UNION ALL SELECT 'macro', round(avg(mean), 4), count(*) FROM G")
def two_level_mean(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    groups = joined.groupBy("n_regionkey", "c_nationkey").agg(F.avg("c_acctbal").alias("m")).groupBy(F.col("n_regionkey").cast("string").alias("group")).agg(F.avg("m").alias("mean"), F.count("*").alias("n"))
    return groups.unionByName(groups.agg(F.lit("macro").alias("group"), F.avg("mean").alias("mean"), F.count("*").alias("n"))).select("group", F.round("mean", 4).alias("mean"), "n")


@register("mean_pm_std", "SELECT c_mktsegment, printf('%.2f', round(avg(c_acctbal), 2)) || ' ± ' || printf('%.2f', round(stddev_samp(c_acctbal), 2)) AS text FROM customer GROUP BY 1")
def mean_pm_std(spark, sf_dir):
    shown = lambda c: F.format_string("%.2f", F.round(c, 2))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.concat(shown(F.avg("c_acctbal")), F.lit(" ± "), shown(F.stddev_samp("c_acctbal"))).alias("text"))


@register("worst_k", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1 ORDER BY avg(c_acctbal), c_nationkey LIMIT 5")
def worst_k(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).orderBy("m", "c_nationkey").limit(5).select("c_nationkey", F.round("m", 4).alias("m"))


@register("quantiles", "SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.9) AS q90, max(c_acctbal) AS q100 FROM customer GROUP BY 1")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("q50"), F.percentile("c_acctbal", F.lit(0.9)).alias("q90"), F.max("c_acctbal").alias("q100"))


@register("manifest_hash", "SELECT sha256(string_agg(n_name || ' ' || n_nationkey, chr(10) ORDER BY n_name || ' ' || n_nationkey)) AS digest FROM nation")
def manifest_hash(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string"))))
    return table(spark, sf_dir, "nation").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


@register("set_operations", "SELECT 'except' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = [found.agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op, found in (("except", a.subtract(b)), ("intersect", a.intersect(b)), ("union", a.union(b).distinct()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("swap_columns", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_suppkey < l_partkey AS swapped FROM lineitem")
def swap_columns(spark, sf_dir):
    swap = F.col("l_suppkey") < F.col("l_partkey")
    pair = F.when(swap, F.struct(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))).otherwise(F.struct(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pair.alias("p"), swap.alias("swapped")).select("l_orderkey", "l_linenumber", "p.a", "p.b", "swapped")


@register("box_geometry", "SELECT p_partkey, greatest(p_size - 5, 0) AS x1, least(p_size + 5, 50) AS x2, round_even((p_size * 1.2) / 2.0, 0)::INT AS half, round(ln((p_size + 1) / 10.0), 6) AS log_aspect FROM part")
def box_geometry(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(size - 5, F.lit(0)).alias("x1"), F.least(size + 5, F.lit(50)).alias("x2"), F.bround(size * F.expr("1.2BD") / F.expr("2.0BD"), 0).cast("int").alias("half"), F.round(F.ln((size + 1) / F.lit(10.0)), 6).alias("log_aspect"))


@register("group_filter", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 2")
def group_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).where("n >= 2")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
