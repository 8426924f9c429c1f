"""Registered queries of data checks, exclusion rules, error analysis, report tables, geometry, strings and loss values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import geometry, text
from strata.functions.sampling import hash_key
from strata.functions.vectors import cosine
from strata.operators import labels, losses, metrics, quality, resampling, similarity
from strata.operators.blocks import complete
from strata.operators.durable import settled
from strata.operators.resampling import draws_sql

from .embedding_queries import _E, rows
from .registry import register, table
from .representation_queries import _PROTO, _agreement_sql, _assigned


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- checks and joins


@register("coverage_check", "SELECT count(DISTINCT doc_id) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_check(spark, sf_dir):
    return quality.missing_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register("raw_faults", """SELECT * FROM (SELECT 'quantity' AS rule, count_if(NOT (l_quantity BETWEEN 1 AND 45)) AS n FROM lineitem UNION ALL SELECT 'discount', count_if(NOT l_discount < 0.095) FROM lineitem UNION ALL SELECT 'flag', count_if(l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem
 UNION ALL SELECT 'unique l_orderkey', sum(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) UNION ALL SELECT 'unique l_orderkey, l_linenumber', sum(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) WHERE n > 0""")  # fmt: skip
def raw_faults(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") < 0.095, "flag": F.col("l_returnflag").isin("A", "N", "R")}
    return quality.faults(table(spark, sf_dir, "lineitem"), rules, [["l_orderkey"], ["l_orderkey", "l_linenumber"]]).select("rule", F.col("n").cast("long").alias("n"))


@register("checked_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def checked_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return quality.checked_join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "many_to_one").select("c_custkey", "n_name")


@register("ordered_lookup", "SELECT o_orderkey AS pos, o_custkey AS id, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ordered_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return quality.in_order(asked, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id")


@register("aligned_columns", "WITH A AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer WHERE c_nationkey < 15 GROUP BY 1), B AS (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier WHERE s_nationkey > 5 GROUP BY 1) SELECT coalesce(A.k, B.k) AS k, round(a, 4) AS a, round(b, 4) AS b FROM A FULL JOIN B ON A.k = B.k")
def aligned_columns(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("b"))
    return a.join(b, "k", "full")


@register("annotation_check", "SELECT (SELECT count(*) FROM (SELECT c_custkey, c_nationkey FROM customer EXCEPT ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 <> 0)) AS missing, (SELECT count(*) FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 <> 0 EXCEPT ALL SELECT c_custkey, c_nationkey FROM customer)) AS extra")
def annotation_check(spark, sf_dir):
    """Two annotated parts together against the whole, record by record, both ways."""
    whole = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = whole.where("c_custkey % 2 = 0 AND c_custkey % 7 != 0").unionByName(whole.where("c_custkey % 2 = 1 AND c_custkey % 7 != 0"))
    missing = whole.exceptAll(parts).agg(F.count("*").alias("missing"))
    return missing.crossJoin(F.broadcast(parts.exceptAll(whole).agg(F.count("*").alias("extra"))))  # one row each


# ---- exclusion and duplicates

_NEAR = 0.35
_X = f"""WITH {_E}, X AS (SELECT id, id % 97 AS digest, fine AS label FROM E), M AS (SELECT digest FROM X GROUP BY digest HAVING min(label) <> max(label))"""


def _exact(spark, sf_dir):
    return rows(spark, sf_dir).select("id", (F.col("id") % 97).alias("digest"), F.col("fine").alias("label"))


def _close(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.pairs_over(side, side, _NEAR).where("a < b").select("a", "b", "sim")


@register("excluded_ids", f"{_X} SELECT id FROM X WHERE digest IN (SELECT digest FROM M) UNION SELECT a FROM P WHERE sim >= {_NEAR} AND fa <> fb")
def excluded_ids(spark, sf_dir):
    exact = _exact(spark, sf_dir)
    return quality.excluded(exact, _close(spark, sf_dir), exact.select("id", "label"))


@register("conflict_pairs", f"{_X} SELECT a, b, a % 97 = b % 97 AS exact, sim >= {_NEAR} AS near FROM P WHERE a < b AND fa <> fb AND (a % 97 = b % 97 OR sim >= {_NEAR})")
def conflict_pairs(spark, sf_dir):
    exact = _exact(spark, sf_dir)
    return quality.conflict_pairs(exact.select("id", "digest"), _close(spark, sf_dir), exact.select("id", "label"))


@register("exclusion_note", "SELECT CASE WHEN d.doc_id % 10 = 0 THEN 'test' WHEN d.doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, count_if(d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS removed FROM documents d GROUP BY 1")
def exclusion_note(spark, sf_dir):
    return quality.exclusion_note(_split(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"), "split", "doc_id")


def _split(spark, sf_dir):
    rest = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(rest == 0, "test").when(rest == 1, "val").otherwise("train").alias("split"))


@register("split_tags", """SELECT lang, count_if(doc_id % 10 = 0) AS test, count_if(doc_id % 10 = 1) AS val, count_if(doc_id % 10 > 1) AS train, count(*) - count(doc_id) AS untagged FROM documents GROUP BY lang""")
def split_tags(spark, sf_dir):
    tagged = _split(spark, sf_dir)
    counts = [F.count_if(F.col("split") == s).alias(s) for s in ("test", "val")] + [F.count_if((F.col("split") == "train") & F.col("doc_id").isNotNull()).alias("train")]
    return tagged.groupBy("lang").agg(*counts, F.count_if(F.col("doc_id").isNull()).alias("untagged"))


@register("similarity_tiers", f"WITH {_E} SELECT t.tier, count_if(sim >= t.edge) AS n FROM P, (VALUES ('0.3', 0.3), ('0.4', 0.4), ('0.5', 0.5)) t(tier, edge) WHERE a < b GROUP BY t.tier")
def similarity_tiers(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return quality.tiers(similarity.pairs_over(side, side, 0.3).where("a < b"), "sim", [0.3, 0.4, 0.5])


@register("similarity_bands", f"WITH {_E} SELECT CASE WHEN sim < 0.4 THEN 0 WHEN sim < 0.5 THEN 1 ELSE 2 END AS band, count(*) AS n, count_if(fa <> fb) AS conflicts FROM P WHERE a < b AND sim >= 0.3 GROUP BY 1")
def similarity_bands(spark, sf_dir):
    side = rows(spark, sf_dir)
    pairs = similarity.pairs_over(side.select("id", "v"), side.select("id", "v"), 0.3).where("a < b")
    of = lambda end: side.select(F.col("id").alias(end), F.col("fine").alias(f"f{end}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.groupBy(labels.left_closed_bins(F.col("sim"), [0.3, 0.4, 0.5, 1.1]).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("fa") != F.col("fb")).alias("conflicts"))


@register("nearest_quantiles", f"WITH {_E}, N AS (SELECT a, max(sim) AS s FROM P GROUP BY a) SELECT round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.9), 6) AS q90, round(quantile_cont(s, 0.99), 6) AS q99, round(max(s), 6) AS q100 FROM N")
def nearest_quantiles(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    near = similarity.top_k(side, side, 1)
    return near.agg(*[F.round(F.percentile("sim", F.lit(q)), 6).alias(f"q{n}") for q, n in ((0.5, 50), (0.9, 90), (0.99, 99))], F.round(F.max("sim"), 6).alias("q100"))


@register("data_summary", f"WITH {_E}, K AS (SELECT coarse, count(DISTINCT fine) AS k_c, count(*) AS n FROM E GROUP BY coarse) SELECT count(*) AS classes, min(k_c) AS min_k, list(k_c ORDER BY k_c)[count(*) // 2 + 1] AS median_k, max(k_c) AS max_k, count_if(k_c = 1) AS single, sum(n)::BIGINT AS n FROM K")
def data_summary(spark, sf_dir):
    per = rows(spark, sf_dir).groupBy("coarse").agg(F.count_distinct("fine").alias("k_c"), F.count("*").alias("n"))
    middle = F.element_at(F.array_sort(F.collect_list("k_c")), (F.floor(F.count("*") / 2) + 1).cast("int"))  # one number a class
    return per.agg(F.count("*").alias("classes"), F.min("k_c").alias("min_k"), middle.alias("median_k"), F.max("k_c").alias("max_k"), F.count_if(F.col("k_c") == 1).alias("single"), F.sum("n").alias("n"))


@register("byte_identical_groups", "WITH D AS (SELECT md5(text) AS digest, doc_id % 2 AS side, count(*) AS n FROM documents GROUP BY ALL) SELECT side, count_if(n > 1) AS groups, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS n FROM D GROUP BY side")
def byte_identical_groups(spark, sf_dir):
    held = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest"), (F.col("doc_id") % 2).alias("side")).agg(F.count("*").alias("n"))
    return held.groupBy("side").agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


# ---- error analysis


def _mixed(df):
    """The rows of coarse classes with two fine classes or more."""
    return df.join(df.groupBy("coarse").agg(F.count_distinct("fine").alias("k")).where("k > 1").select("coarse"), "coarse", "left_semi")


_MIXED = "(SELECT coarse FROM E GROUP BY coarse HAVING count(DISTINCT fine) > 1)"
_CASES = f"""WITH {_E}, Q AS (SELECT a, b, ca, round(sim, 9) AS sim, fa = fb AS same FROM P WHERE a < b AND ca = cb AND ca IN {_MIXED}),
N AS (SELECT 'false' AS kind, row_number() OVER (ORDER BY sim DESC, a, b) AS place, a, b, sim FROM Q WHERE NOT same QUALIFY place <= 20 UNION ALL SELECT 'missed', row_number() OVER (ORDER BY sim, a, b) AS place, a, b, sim FROM Q WHERE same QUALIFY place <= 20),
K AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM P WHERE ca = cb),
F AS (SELECT kind, place, CASE WHEN y.rank < x.rank THEN N.b ELSE N.a END AS a, CASE WHEN y.rank < x.rank THEN N.a ELSE N.b END AS b, sim, least(x.rank, y.rank) AS rank_ab, greatest(x.rank, y.rank) AS rank_ba FROM N JOIN K x ON x.a = N.a AND x.b = N.b JOIN K y ON y.a = N.b AND y.b = N.a)"""


def _failures(spark, sf_dir, n: int = 20):
    """(kind, place, a, b, sim, rank_ab, rank_ba): the failures, a is the row that ranks the other higher within the class."""
    side = _mixed(rows(spark, sf_dir)).select("id", "v", F.col("coarse").alias("g"), "fine")
    found = settled(quality.failure_cases(similarity.extreme_pairs(side, "fine", n), n))
    asked = lambda a, b: found.select(F.col(a).alias("id"), F.col(b).alias("target")).join(side, "id").join(side.select(F.col("id").alias("target"), F.col("v").alias("w")), "target").select("id", "target", "v", "g", cosine(F.col("v"), F.col("w")).alias("sim"))
    ranks = settled(similarity.ranks_in(asked("a", "b").unionByName(asked("b", "a")), side))
    one = lambda a, b, name: ranks.select(F.col("id").alias(a), F.col("target").alias(b), F.col("rank").alias(name))
    ranked = found.join(one("a", "b", "rank_ab"), ["a", "b"]).join(one("b", "a", "rank_ba"), ["a", "b"])
    return quality.oriented(ranked)


@register("failure_cases", f"{_CASES} SELECT kind, place::INT AS place, a, b, round(sim, 6) AS sim, rank_ab::INT AS rank_ab, rank_ba::INT AS rank_ba FROM F")
def failure_cases(spark, sf_dir):
    return _failures(spark, sf_dir).select("kind", "place", "a", "b", F.round("sim", 6).alias("sim"), "rank_ab", "rank_ba")


@register("failure_controls", f"""{_CASES}, R AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM P WHERE fa = fb)
SELECT F.a AS query, F.b AS partner, R.b AS other, R.rank::INT AS rank FROM F JOIN R ON R.a = F.a AND R.b <> F.b QUALIFY row_number() OVER (PARTITION BY F.a, F.b ORDER BY R.rank) = 1""")  # fmt: skip
def failure_controls(spark, sf_dir):
    df = rows(spark, sf_dir)
    side = df.select("id", "v", F.col("fine").alias("g"))
    asked = _failures(spark, sf_dir).select(F.col("a").alias("query"), F.col("b").alias("partner"))
    return quality.best_alternatives(asked, similarity.top_k(side, side, 2))


@register("closest_pairs", f"WITH {_E} SELECT a, b, round(sim, 6) AS sim FROM P WHERE a < b ORDER BY P.sim DESC, a, b LIMIT 25")
def closest_pairs(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.closest(side, 25).select("a", "b", F.round("sim", 6).alias("sim"))


@register("neighbour_ranks", f"WITH {_E} SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b)::INT AS rank FROM P WHERE fa = fb")
def neighbour_ranks(spark, sf_dir):
    return similarity.all_ranks(rows(spark, sf_dir).select("id", "v", F.col("fine").alias("g")))


_TWO = f"""WITH {_E}, W AS (SELECT a.coarse, a.id AS a, b.id AS b, a.fine = b.fine AS same, round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) AS f, round(list_cosine_similarity(a.v[33:64], b.v[33:64]), 9) AS s FROM E a JOIN E b ON a.coarse = b.coarse AND a.id <> b.id WHERE a.coarse IN {_MIXED}),
Z AS (SELECT *, round((f - avg(f) OVER w) / stddev_pop(f) OVER w - (s - avg(s) OVER w) / stddev_pop(s) OVER w, 6) AS score FROM W WINDOW w AS (PARTITION BY coarse))"""


def _nearest_half(df, k: int):
    """(coarse, a, b, same, first, second): the k others of a row's class that are most similar by the first 32 components."""
    found = similarity.top_k(*[df.select("id", "v", F.col("coarse").alias("g"))] * 2, k, digits=9, at=32)
    of = lambda end: df.select(F.col("id").alias(end), F.col("fine").alias(f"f{end}"), *([F.col("coarse")] if end == "a" else []))
    pairs = found.join(of("a"), "a").join(of("b"), "b")
    return pairs.select("coarse", "a", "b", (F.col("fa") == F.col("fb")).alias("same"), F.col("sim").alias("first"), F.round("second", 9).alias("second"))


def _scored(spark, sf_dir, k: int):
    """``_nearest_half`` of the mixed classes, with the identity score; means and deviations are those of all pairs of the class."""
    df = _mixed(rows(spark, sf_dir))
    whole = similarity.pair_moments(df.select("id", "v", F.col("coarse").cast("long").alias("g")), 32, 9).withColumnRenamed("g", "coarse")
    z = lambda c, i: F.try_divide(F.col(c) - F.col(f"m{i}"), F.col(f"s{i}"))
    return _nearest_half(df, k).join(F.broadcast(whole), "coarse").withColumn("score", F.round(z("first", 0) - z("second", 1), 6))  # one row a class


#: As ``_TWO``, over every coarse class.
_EVERY_TWO = _TWO.replace(f" WHERE a.coarse IN {_MIXED}", "")


@register("identity_precision", f"""{_EVERY_TWO}, T AS (SELECT coarse, same FROM Z QUALIFY row_number() OVER (PARTITION BY a ORDER BY f DESC, b) <= 5) SELECT t.coarse, round(precision, 6) AS precision, round(chance, 6) AS chance
FROM (SELECT coarse, avg(same::INT) AS precision FROM T GROUP BY coarse) t JOIN (SELECT coarse, avg(same::INT) AS chance FROM Z GROUP BY coarse) c USING (coarse)""")  # fmt: skip
def identity_precision(spark, sf_dir):
    df = complete(rows(spark, sf_dir)).where("id IS NOT NULL")
    found = quality.precision_of(_nearest_half(df, 5), "coarse", "first", 5).groupBy("coarse").agg((F.sum("hits") / F.sum("found")).alias("precision"))
    n = F.col("n")
    chance = df.groupBy("coarse", "fine").agg(F.count("*").cast("double").alias("n")).groupBy("coarse").agg(F.try_divide(F.sum(n * (n - 1)), F.sum(n) * (F.sum(n) - 1)).alias("chance"))
    return found.join(chance, "coarse").select("coarse", *_six("precision", "chance"))


_GAIN = f"""{_TWO}, G AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY f DESC, b) AS place FROM Z), S AS (SELECT a, coarse, avg(same::INT) AS gated FROM (SELECT * FROM G WHERE place <= 20 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5) GROUP BY ALL),
R AS (SELECT a, coarse, gated, plain, gated - plain AS gain FROM S JOIN (SELECT a, avg(same::INT) AS plain FROM G WHERE place <= 5 GROUP BY a) USING (a)),
Y AS (SELECT R.*, b, {draws_sql('a', 'b', 0)} AS w FROM R, range(0, 1001) t(b)), M AS (SELECT coarse::VARCHAR AS grp, b, metric, v FROM (SELECT coarse, b, sum(w * gain) / sum(w) AS gain, sum(w * gated) / sum(w) AS gated, sum(w * plain) / sum(w) AS plain FROM Y GROUP BY ALL) UNPIVOT (v FOR metric IN (gain, gated, plain))),
A AS (SELECT * FROM M UNION ALL SELECT 'macro', b, metric, avg(v) FROM M GROUP BY ALL),
I AS (SELECT grp, metric, max(CASE WHEN b = 0 THEN v END) AS mean, quantile_cont(CASE WHEN b > 0 THEN v END, 0.025) AS lo, quantile_cont(CASE WHEN b > 0 THEN v END, 0.975) AS hi FROM A GROUP BY ALL)
SELECT grp AS "group", metric, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN grp = 'macro' AND metric = 'gain' THEN CASE WHEN mean >= 0.02 AND lo > 0 THEN 'go' ELSE 'stop' END END AS decision FROM I"""


@register("identity_gain", _GAIN)
def identity_gain(spark, sf_dir):
    """How much better the five best by the identity score, of the 20 most similar, are than the five most similar, with intervals over resampled rows; and the decision, which the lower end of the gain's interval takes part in."""
    scored = settled(_scored(spark, sf_dir, 20))
    plain = quality.precision_of(scored, "coarse", "first", 5).select("a", "coarse", F.col("precision").alias("plain"))
    gated = quality.precision_of(scored, "coarse", "score", 5, "first", 20).select("a", F.col("precision").alias("gated"))
    gains = plain.join(gated, "a").withColumn("gain", F.col("gated") - F.col("plain"))
    table = resampling.intervals(gains, "coarse", "a", resampling.means_of(["plain", "gated", "gain"]), ["plain", "gated", "gain"])
    decided = F.when((F.col("group") == "macro") & (F.col("metric") == "gain"), quality.go_or_stop(F.col("mean"), F.col("lo")))
    return table.select("group", "metric", *_six("mean", "lo", "hi"), decided.alias("decision"))


# ---- report tables


def _long(spark, sf_dir):
    """(group, metric, mean, lo, hi, n) over nations: the mean balance and the mean of a flag, undefined in one nation."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").cast("double").alias("balance"), F.when(F.col("c_nationkey") != 3, F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("positive"))
    return metrics.point_table(customers, "c_nationkey", ["balance", "positive"])


_LONG = """WITH C AS (SELECT c_nationkey, avg(c_acctbal) AS balance, avg(CASE WHEN c_nationkey <> 3 THEN CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END END) AS positive, count(*) AS n FROM customer GROUP BY 1)"""


@register("headline_table", f"{_LONG} SELECT 'level' AS evaluates, 'balance' AS metric, round(avg(balance), 6) AS mean, true AS validated FROM C UNION ALL SELECT 'share', 'positive', round(avg(positive), 6), false FROM C")
def headline_table(spark, sf_dir):
    found = quality.headline(_long(spark, sf_dir), {"level": ["balance"], "share": ["positive"]}, {"balance"})
    return found.select("evaluates", "metric", *_six("mean"), "validated")


@register("metric_of_table", f"{_LONG} SELECT round(avg(positive), 6) AS mean, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM C")
def metric_of_table(spark, sf_dir):
    return quality.read_metric(_long(spark, sf_dir), "positive").select(*_six("mean"), "lo", "hi")


@register("wide_table", f"{_LONG} SELECT c_nationkey::VARCHAR AS \"group\", round(balance, 6) AS balance, round(positive, 6) AS positive FROM C")
def wide_table(spark, sf_dir):
    return quality.wide(_long(spark, sf_dir), ["balance", "positive"]).select("group", *_six("balance", "positive"))


@register("worst_groups", f"{_LONG} SELECT c_nationkey::VARCHAR AS \"group\", round(positive, 6) AS positive FROM C WHERE positive IS NOT NULL ORDER BY C.positive, c_nationkey::VARCHAR LIMIT 5")
def worst_groups(spark, sf_dir):
    return quality.worst(quality.wide(_long(spark, sf_dir), ["balance", "positive"]), "positive", 5).select("group", *_six("positive"))


@register("control_matrix", """WITH G AS (SELECT l_returnflag AS control, l_linestatus AS metric, avg(l_discount) AS mean FROM lineitem GROUP BY ALL), B AS (SELECT avg(l_discount) AS base FROM lineitem), V AS (SELECT control, metric, CASE WHEN mean - base > 0.00001 * greatest(abs(base), 1e-3) THEN CASE WHEN control = 'R' THEN 'ok' ELSE 'also' END ELSE CASE WHEN control = 'R' THEN 'MISSED' ELSE 'same' END END AS verdict FROM G, B)
SELECT control, max(CASE WHEN metric = 'F' THEN verdict END) AS "F", max(CASE WHEN metric = 'O' THEN verdict END) AS "O" FROM V GROUP BY control""")  # fmt: skip
def control_matrix(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    point = F.struct(F.avg("l_discount").cast("double").alias("mean"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    groups = items.groupBy(F.col("l_returnflag").alias("control"), F.col("l_linestatus").alias("metric")).agg(point.alias("v"))
    both = groups.crossJoin(F.broadcast(items.agg(point.alias("b"))))  # one row
    judged = both.select("control", "metric", metrics.verdict(metrics.worse_than("v", "b", F.lit(True), 0.00001), F.col("control") == "R").alias("verdict"))
    return judged.groupBy("control").pivot("metric", ["F", "O"]).agg(F.first("verdict"))


@register("floor_table", "WITH S AS (SELECT c_mktsegment AS \"set\", avg(c_acctbal) AS value FROM customer GROUP BY 1), B AS (SELECT value AS floor FROM S WHERE \"set\" = 'BUILDING') SELECT \"set\", round(value, 4) AS value, round(value - floor, 4) AS excess, round(value / floor, 6) AS ratio FROM S, B")
def floor_table(spark, sf_dir):
    sets = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("set")).agg(F.avg("c_acctbal").cast("double").alias("value"))
    floor = sets.where("`set` = 'BUILDING'").select(F.col("value").alias("floor"))
    both = sets.crossJoin(F.broadcast(floor))  # one row
    return both.select("set", F.round("value", 4).alias("value"), F.round(F.col("value") - F.col("floor"), 4).alias("excess"), F.round(F.col("value") / F.col("floor"), 6).alias("ratio"))


@register("seed_summary", "WITH S AS (SELECT c_mktsegment AS run, c_custkey % 3 AS seed, avg(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT run, count(*) AS seeds, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM S GROUP BY run")
def seed_summary(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run"), (F.col("c_custkey") % 3).alias("seed")).agg(F.avg("c_acctbal").cast("double").alias("m"))
    return seeds.groupBy("run").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("std"))


@register("refused_encoders", "WITH D AS (SELECT n_regionkey AS method, n_name AS encoder, substr(n_name, 1, 1) AS family FROM nation), V AS (SELECT encoder, family FROM D WHERE method = 1) SELECT method, encoder, 'same' AS why FROM D WHERE encoder IN (SELECT encoder FROM V) UNION ALL SELECT method, encoder, 'family' FROM D WHERE encoder NOT IN (SELECT encoder FROM V) AND family IN (SELECT family FROM V)")
def refused_encoders(spark, sf_dir):
    declared = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("method"), F.col("n_name").alias("encoder"), F.substring("n_name", 1, 1).alias("family"))
    return quality.refused_pairs(declared, declared.where("method = 1").select("encoder", "family"))


@register("balanced_batch", "WITH H AS (SELECT c_nationkey, c_custkey, md5('23:' || c_custkey) AS h FROM customer), G AS (SELECT c_nationkey FROM H GROUP BY 1 HAVING count(*) >= 4 ORDER BY min(h), c_nationkey LIMIT 6) SELECT c_nationkey, c_custkey FROM H WHERE c_nationkey IN (SELECT c_nationkey FROM G) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY h, c_custkey) <= 4")
def balanced_batch(spark, sf_dir):
    return quality.balanced_batch(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", 6, 4, hash_key(F.lit(23), F.col("c_custkey")))


@register("pivot_values", "SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 4) AS \"BUILDING\", round(avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 4) AS \"MACHINERY\" FROM customer GROUP BY 1")
def pivot_values(spark, sf_dir):
    found = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.avg("c_acctbal"))
    return found.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("BUILDING", "MACHINERY")])


@register("upper_median", "SELECT c_mktsegment, min(c_acctbal) AS low, list(c_acctbal ORDER BY c_acctbal)[count(*) // 2 + 1] AS median, max(c_acctbal) AS high FROM customer GROUP BY 1")
def upper_median(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal"))
    size = F.count("*").over(Window.partitionBy("c_mktsegment"))
    placed = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", rank.alias("r"), size.alias("n"))
    middle = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("c_acctbal")))
    return placed.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), middle.alias("median"), F.max("c_acctbal").alias("high"))


@register("sorted_codes", "SELECT DISTINCT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def sorted_codes(spark, sf_dir):
    return labels.codes_sorted(table(spark, sf_dir, "customer"), "c_mktsegment").select("c_mktsegment", F.col("code").cast("long").alias("code"))


@register("feature_metrics", f"""WITH {_E}, K AS (SELECT coarse, count(DISTINCT fine) AS k FROM E GROUP BY coarse), D AS (SELECT ca AS coarse, avg(CASE WHEN fa = fb THEN 2 - 2 * sim END) AS d0, avg(CASE WHEN ca = cb AND fa <> fb THEN 2 - 2 * sim END) AS d1, avg(CASE WHEN ca <> cb THEN 2 - 2 * sim END) AS d2 FROM P GROUP BY ca)
SELECT round(avg(d0), 6) AS d0, round(avg(d1) FILTER (k >= 2), 6) AS d1, round(avg(d2), 6) AS d2, round(quantile_cont(d0 / d1, 0.5), 6) AS median_r01, round(100 * avg((d0 < d1)::INT) FILTER (d1 IS NOT NULL), 4) AS pct_eq1 FROM D JOIN K USING (coarse)""")  # fmt: skip
def feature_metrics(spark, sf_dir):
    from .embedding_queries import unit_rows

    df = unit_rows(spark, sf_dir)
    kinds = df.groupBy("coarse").agg(F.count_distinct("fine").alias("k"))
    found = metrics.geometry_ratios(metrics.pair_distances(df)).join(kinds, "coarse")
    return found.agg(
        F.round(F.avg("d0"), 6).alias("d0"), F.round(F.avg(F.when(F.col("k") >= 2, F.col("d1"))), 6).alias("d1"), F.round(F.avg("d2"), 6).alias("d2"),
        F.round(F.percentile("r01", F.lit(0.5)), 6).alias("median_r01"), F.round(100 * F.avg("eq1"), 4).alias("pct_eq1"),
    )


@register("assignment_change", f"""WITH {_E}, {_PROTO}, B AS (SELECT id, coarse, y, first(c ORDER BY round(s, 9) DESC, c) AS c, first(c ORDER BY round(f, 9) DESC, c) AS flip FROM O GROUP BY ALL),
U AS (SELECT coarse, sum(m) / sum(n) AS purity FROM (SELECT coarse, c, max(n) AS m, sum(n) AS n FROM (SELECT coarse, c, y, count(*) AS n FROM B GROUP BY ALL) GROUP BY ALL) GROUP BY coarse)
SELECT coarse, round(changed, 6) AS changed, round(ari, 6) AS ari, round(purity, 6) AS purity FROM (SELECT coarse, avg((c <> flip)::INT) AS changed FROM B GROUP BY coarse) JOIN (SELECT coarse, ari FROM {_agreement_sql('B', 'c', 'flip')}) USING (coarse) JOIN U USING (coarse)""")  # fmt: skip
def assignment_change(spark, sf_dir):
    own = _assigned(spark, sf_dir)
    changed = own.groupBy("coarse").agg(F.avg(F.when(F.col("c") != F.col("flip"), 1.0).otherwise(0.0)).alias("changed"))
    cells = own.groupBy("coarse", "c", "y").agg(F.count("*").alias("n")).groupBy("coarse", "c").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    purity = cells.groupBy("coarse").agg((F.sum("m") / F.sum("n")).alias("purity"))
    return changed.join(metrics.agreement_by(own, "coarse", "c", "flip").select("coarse", "ari"), "coarse").join(purity, "coarse").select("coarse", *_six("changed", "ari", "purity"))


@register("subclass_recall")
def subclass_recall(spark, sf_dir):
    return quality.subclass_recall(_assigned(spark, sf_dir).withColumn("c", F.col("flip")), "y", "c")


_M = "(SELECT fine, coarse, list(x ORDER BY i) AS c FROM (SELECT fine, coarse, i, avg(v[i]) AS x FROM E, range(1, 65) t(i) {} GROUP BY ALL) GROUP BY ALL)"


def _prototypes(df):
    parts = df.select("fine", "coarse", F.posexplode("v").alias("i", "x")).groupBy("fine", "coarse", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("fine", "coarse").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))


@register("prototype_cosines", f"WITH {_E}, C AS {_M.format('')} SELECT a.coarse, a.fine AS a, b.fine AS b, round(list_cosine_similarity(a.c, b.c), 6) AS sim FROM C a JOIN C b ON a.coarse = b.coarse AND a.fine < b.fine")
def prototype_cosines(spark, sf_dir):
    means = _prototypes(rows(spark, sf_dir))
    a, b = (means.select("coarse", F.col("fine").alias(n), F.col("m").alias(f"m_{n}")) for n in "ab")
    return a.join(F.broadcast(b), "coarse").where("a < b").select("coarse", "a", "b", F.round(cosine(F.col("m_a"), F.col("m_b")), 6).alias("sim"))


@register("prototype_drift", f"WITH {_E}, A AS {_M.format('WHERE id % 2 = 0')}, B AS {_M.format('WHERE id % 2 = 1')} SELECT A.fine, round(1 - list_cosine_similarity(A.c, B.c), 6) AS drift FROM A JOIN B ON A.fine = B.fine")
def prototype_drift(spark, sf_dir):
    df = rows(spark, sf_dir)
    old, new = _prototypes(df.where("id % 2 = 0")), _prototypes(df.where("id % 2 = 1")).select("fine", F.col("m").alias("m2"))
    return old.join(new, "fine").select("fine", F.round(1 - cosine(F.col("m"), F.col("m2")), 6).alias("drift"))


@register("active_prototypes", f"WITH {_E}, {_PROTO}, B AS (SELECT id, coarse, first(c ORDER BY round(s, 9) DESC, c) AS c FROM O GROUP BY ALL) SELECT coarse, c, count(*) AS n FROM B GROUP BY ALL HAVING count(*) >= 40")
def active_prototypes(spark, sf_dir):
    return losses.active_prototypes(_assigned(spark, sf_dir), "coarse", "c", 40)


# ---- geometry

_BOX = """WITH B AS (SELECT p_partkey AS id, 40 + p_size AS w, 30 + p_partkey % 25 AS h, 1 + p_partkey % 11 AS x1, 1 + p_partkey % 7 AS y1, p_partkey % 11 + 5 + p_size AS x2, p_partkey % 7 + 4 + p_partkey % 23 AS y2 FROM part),
C AS (SELECT id, w, h, greatest(0, x1 - 1) AS x1, greatest(0, y1 - 1) AS y1, least(w, x2) AS x2, least(h, y2) AS y2 FROM B),
M AS (SELECT *, greatest(x2 - x1, y2 - y1) AS m FROM C), S AS (SELECT *, greatest(round_even(CASE WHEN m * 1.5::DOUBLE > least(w, h) THEN greatest(least(w, h)::DOUBLE, m * 1.02::DOUBLE) ELSE m * 1.5::DOUBLE END, 0)::INT, m) AS side FROM M),
L AS (SELECT *, CASE WHEN side > w THEN -((side - w) // 2) ELSE least(greatest(least(greatest(round_even((x1 + x2) / 2 - side / 2, 0)::INT, x2 - side), x1), 0), w - side) END AS wx, CASE WHEN side > w THEN (side - w) // 2 ELSE 0 END AS pl, CASE WHEN side > w THEN side - w - (side - w) // 2 ELSE 0 END AS pr,
 CASE WHEN side > h THEN -((side - h) // 2) ELSE least(greatest(least(greatest(round_even((y1 + y2) / 2 - side / 2, 0)::INT, y2 - side), y1), 0), h - side) END AS wy, CASE WHEN side > h THEN (side - h) // 2 ELSE 0 END AS pt, CASE WHEN side > h THEN side - h - (side - h) // 2 ELSE 0 END AS pb FROM S),
F AS (SELECT *, (side * side - (side - pl - pr) * (side - pt - pb)) / (side * side) AS pad FROM L)"""


def _windows(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, sf_dir, "part").select(p.alias("id"), (40 + n).cast("int").alias("w"), (30 + p % 25).cast("int").alias("h"), *[c.cast("int").alias(k) for k, c in (("x1", 1 + p % 11), ("y1", 1 + p % 7), ("x2", p % 11 + 5 + n), ("y2", p % 7 + 4 + p % 23))])
    boxes = boxes.select("id", "w", "h", geometry.pixel_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "w", "h")]).alias("box"))
    boxes = boxes.withColumn("side", geometry.window_side(F.col("box"), F.col("w"), F.col("h")))
    boxes = boxes.withColumn("across", geometry.placed(F.col("box.x1"), F.col("box.x2"), F.col("side"), F.col("w"))).withColumn("down", geometry.placed(F.col("box.y1"), F.col("box.y2"), F.col("side"), F.col("h")))
    return boxes.withColumn("pad", geometry.pad_fraction(F.col("side"), F.col("across"), F.col("down")))


@register("square_windows", f"{_BOX} SELECT id, side, wx, wy, pl, pr, pt, pb, round(pad, 6) AS pad, round((x1 - wx) * (128.0::DOUBLE / side), 6) AS x1, round((y2 - wy) * (128.0::DOUBLE / side), 6) AS y2 FROM F")
def square_windows(spark, sf_dir):
    df = _windows(spark, sf_dir).withColumn("inside", geometry.box_in_window(F.col("box"), F.col("across"), F.col("down"), F.col("side"), 128))
    return df.select(
        "id", "side", F.col("across.start").alias("wx"), F.col("down.start").alias("wy"), F.col("across.pad_low").alias("pl"), F.col("across.pad_high").alias("pr"),
        F.col("down.pad_low").alias("pt"), F.col("down.pad_high").alias("pb"), *_six("pad"), F.round("inside.x1", 6).alias("x1"), F.round("inside.y2", 6).alias("y2"),
    )


@register("window_summary", f"{_BOX} SELECT count(*) AS n, count_if(pad > 0) AS padded, round(avg(pad), 6) AS mean_pad, round(quantile_cont(side, 0.5), 4) AS median_side, round(avg(side / m), 6) AS margin, count_if(pad > 0 AND m * 1.02::DOUBLE <= least(w, h)) AS needless FROM F")
def window_summary(spark, sf_dir):
    longer = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    return _windows(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("pad") > 0).alias("padded"), F.round(F.avg("pad"), 6).alias("mean_pad"), F.round(F.percentile("side", F.lit(0.5)), 4).alias("median_side"),
        F.round(F.avg(F.col("side") / longer), 6).alias("margin"), F.count_if((F.col("pad") > 0) & (longer * F.lit(1.02) <= F.least("w", "h"))).alias("needless"),
    )


# ---- strings and nested values


@register("model_names", """WITH N AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Land Rover ' ELSE 'Audi ' END || 'Type ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' x' ELSE ' ' || (1980 + p_size % 45) END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, ' (19|20)[0-9][0-9]$') THEN CASE WHEN p_partkey % 3 = 0 THEN 'Land Rover' ELSE 'Audi' END END AS make, CASE WHEN regexp_matches(name, ' (19|20)[0-9][0-9]$') THEN 'Type ' || regexp_extract(name, 'Type ([0-9]+)', 1) END AS model, CASE WHEN regexp_matches(name, ' (19|20)[0-9][0-9]$') THEN right(name, 4)::INT END AS year FROM N""")  # fmt: skip
def model_names(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(p % 3 == 0, "Land Rover ").otherwise("Audi "), F.lit("Type "), n, F.when(p % 5 == 0, F.lit(" x")).otherwise(F.concat(F.lit(" "), (1980 + n % 45).cast("string"))))
    parsed = table(spark, sf_dir, "part").select("p_partkey", labels.parse_model_name(name, ["Land Rover", "Aston Martin"]).alias("m"))
    return parsed.select("p_partkey", "m.make", "m.model", "m.year")


@register("string_parts", """SELECT page_id, split_part(url, '/', 3) AS host, regexp_replace(url, '^https?://', '') AS bare, split_part(url, '/', -1) AS last, trim('  ' || page_id || ' ') AS trimmed, contains(url, '+') AS plus, left(url, length(url) - 4) AS cut, lpad(page_id::VARCHAR, 8, '0') AS padded FROM pages""")
def string_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), text.without_prefix(u, ["https://", "http://"]).alias("bare"), F.split_part(u, F.lit("/"), F.lit(-1)).alias("last"),
        F.trim(F.concat(F.lit("  "), "page_id", F.lit(" "))).alias("trimmed"), u.rlike(r"\+").alias("plus"), text.cut_end(u, 4).alias("cut"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"),
    )


@register("html_escaped", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("digest"))


@register("json_header", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_header(spark, sf_dir):
    """A header with nested records, to one JSON text and back."""
    record = F.struct("n_nationkey", "n_name", "n_regionkey")
    nested = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(record).alias("rows"))).alias("j"))  # one text a region
    back = nested.select(F.from_json("j", "version int, rows array<struct<n_nationkey:bigint,n_name:string,n_regionkey:bigint>>").alias("x"))
    return back.select(F.explode("x.rows").alias("r")).select("r.*")


@register("array_functions", f"WITH {_E} SELECT id, list_position(v, list_max(v)) - 1 AS best, (list_grade_up(v)[1] - 1)::INT AS least, len(list_filter(v, lambda x: x > 0)) AS positive, round(v[3], 6) AS third, round(list_sum(v[5:8]), 6) AS piece FROM E")
def array_functions(spark, sf_dir):
    v = F.col("v")
    return rows(spark, sf_dir).select(
        "id", (F.array_position(v, F.array_max(v)) - 1).cast("long").alias("best"), (F.array_position(v, F.array_min(v)) - 1).cast("int").alias("least"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(F.get(v, F.lit(2)).cast("double"), 6).alias("third"), F.round(F.aggregate(F.slice(v, 5, 4), F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("piece"),
    )


# ---- loss values


@register("supervised_contrastive", f"""WITH {_E}, S AS (SELECT a, sum(exp(sim / 0.1 - 10)) AS e, sum(CASE WHEN fa = fb THEN sim / 0.1 ELSE 0 END) AS p, count_if(fa = fb) AS n FROM P GROUP BY a) SELECT round(avg(ln(e) + 10 - p / n), 6) AS loss FROM S WHERE n > 0""")
def supervised_contrastive(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", "v", F.col("fine").alias("y"))
    return losses.supervised_contrastive(df, 0.1).select(*_six("loss"))


_SOFT = f"""WITH {_E}, {_PROTO}, W AS (SELECT id, coarse, y, c, exp(s / 0.1) AS w FROM O), A AS (SELECT id, coarse, y, c, w / sum(w) OVER (PARTITION BY id) AS p FROM W)"""


def _soft(spark, sf_dir):
    """(id, coarse, y, c, p): softmax over the cosines to the prototypes of the row's own class, whose fine classes are c in order."""
    df = rows(spark, sf_dir)
    means = _prototypes(df).groupBy("coarse").agg(F.array_sort(F.collect_list(F.struct(F.col("fine").alias("c"), "m"))).alias("protos"))  # as long as a class has fine ones
    joined = df.join(F.broadcast(means), "coarse").select("id", "coarse", F.col("fine").alias("y"), F.transform("protos", lambda p: p["c"]).alias("c"), F.transform("protos", lambda p: cosine(F.col("v"), p["m"])).alias("s"))
    return joined.select("id", "coarse", "y", "c", losses.soft_assignment(F.col("s"), 0.1).alias("p"))


@register("assignment_entropy", f"{_SOFT} SELECT id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(-ln(max(CASE WHEN c = y THEN p END)), 6) + 0.0 AS loss FROM A GROUP BY id")
def assignment_entropy(spark, sf_dir):
    own = F.aggregate(F.arrays_zip("c", "p"), F.lit(0.0), lambda s, e: s + F.when(e["c"] == F.col("y"), e["p"]).otherwise(0.0))
    return _soft(spark, sf_dir).select("id", (F.round(losses.entropy(F.col("p")), 6) + 0.0).alias("entropy"), (F.round(-F.ln(own), 6) + 0.0).alias("loss"))


@register("prototype_usage", f"{_SOFT}, U AS (SELECT coarse, c, avg(p) AS share FROM A GROUP BY ALL) SELECT coarse, (row_number() OVER (PARTITION BY coarse ORDER BY c) - 1)::INT AS z, round(share, 6) AS share, share >= 0.3 AS active FROM U")
def prototype_usage(spark, sf_dir):
    return losses.active(losses.usage(_soft(spark, sf_dir), "coarse", "p"), 0.3).select("coarse", "z", *_six("share"), "active")


@register("hierarchy_loss", f"""WITH {_E}, D AS (SELECT ca AS coarse, avg(CASE WHEN fa = fb THEN 2 - 2 * sim END) AS d0, avg(CASE WHEN ca = cb AND fa <> fb THEN 2 - 2 * sim END) AS d1 FROM P GROUP BY ca) SELECT coarse, round(greatest(d0 - d1 + 0.05, 0), 6) AS loss FROM D WHERE d1 IS NOT NULL""")
def hierarchy_loss(spark, sf_dir):
    from .embedding_queries import unit_rows

    found = metrics.pair_distances(unit_rows(spark, sf_dir)).where("d1 IS NOT NULL")
    return found.select("coarse", F.round(losses.hierarchy_penalty(F.col("d0"), F.col("d1"), 0.05), 6).alias("loss"))


@register("joint_log_probability", f"""WITH {_E}, L AS (SELECT id, i, v[i] - ln(list_sum(list_transform(v[1:4], lambda x: exp(x)))) AS z FROM E, range(1, 5) t(i)), J AS (SELECT id, y, ln(sum(exp(z + CASE WHEN (i - 1) // 2 = y THEN ln(0.9) ELSE ln(0.1) END))) AS l FROM L, range(0, 2) t(y) GROUP BY ALL) SELECT id, y::INT AS y, round(l, 6) AS l FROM J""")
def joint_log_probability(spark, sf_dir):
    z = F.transform(F.slice("v", 1, 4), lambda x: x.cast("double"))
    whole = losses.log_sum_exp(z)
    log_z = F.zip_with(z, F.array_repeat(whole, 4), lambda a, t: a - t)
    given = F.array(*[F.array(*[F.ln(F.lit(0.9 if i // 2 == y else 0.1)) for i in range(4)]) for y in range(2)])
    return rows(spark, sf_dir).select("id", F.posexplode(losses.joint_log(log_z, given)).alias("y", "l")).select("id", "y", *_six("l"))


@register("equal_assignment")
def equal_assignment(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", F.transform(F.slice("v", 1, 5), lambda x: x.cast("double")).alias("s"))
    return losses.sinkhorn(df, F.col("s"), epsilon=0.2).select("id", "q")
