"""Registered queries of representation metrics per coarse class: probes, spectra, geometry ratios, label-free K and stability."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from strata.functions.vectors import cosine, unit
from strata.operators import clustering, clusterings, metrics, nuisance, similarity, spectra
from strata.operators.durable import settled

from .embedding_queries import _E, _TRAIN, _top, rows, unit_rows
from .registry import register

_U = f"{_E}, U AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM E)"


def _six(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]  # no minus zero


def _train():
    return F.expr("substr(md5(CAST(id AS STRING)), 1, 1) < '8'")


@register("geometry_ratios", f"""WITH {_E}, D AS (SELECT ca AS coarse, avg(CASE WHEN fa = fb THEN 2 - 2 * sim END) AS d0, avg(CASE WHEN ca = cb AND fa <> fb THEN 2 - 2 * sim END) AS d1, avg(CASE WHEN ca <> cb THEN 2 - 2 * sim END) AS d2 FROM P GROUP BY ca),
K AS (SELECT coarse, count(*) AS n, count(DISTINCT fine) AS k_c FROM E GROUP BY coarse)
SELECT coarse, n, k_c, round(d0 / d1, 6) AS r01, round(d1 / d2, 6) AS r12, CASE WHEN d1 IS NOT NULL THEN (d0 < d1)::INT::DOUBLE END AS eq1, CASE WHEN d1 IS NOT NULL THEN (d1 < d2)::INT::DOUBLE END AS eq2 FROM D JOIN K USING (coarse)""")  # fmt: skip
def geometry_ratios(spark, sf_dir):
    df = unit_rows(spark, sf_dir)
    sizes = df.groupBy("coarse").agg(F.count("*").alias("n"), F.count_distinct("fine").alias("k_c"))
    return metrics.geometry_ratios(metrics.pair_distances(df)).join(sizes, "coarse").select("coarse", "n", "k_c", *_six("r01", "r12"), "eq1", "eq2")


@register("variance_ratio", f"""WITH {_U}, X AS (SELECT coarse, fine, i, u[i] AS x FROM U, range(1, 65) t(i)), V AS (SELECT coarse, fine, sum(s) AS t, max(n) AS n FROM (SELECT coarse, fine, i, var_samp(x) AS s, count(*) AS n FROM X GROUP BY ALL) GROUP BY ALL),
W AS (SELECT coarse, sum(s) AS t FROM (SELECT coarse, i, var_samp(x) AS s FROM X GROUP BY ALL) GROUP BY coarse)
SELECT coarse, round((SELECT sum(n * t) / sum(n) FROM V WHERE V.coarse = W.coarse AND n >= 3) / t, 6) AS var_ratio FROM W""")  # fmt: skip
def variance_ratio(spark, sf_dir):
    return metrics.variance_ratio(unit_rows(spark, sf_dir)).select("coarse", *_six("var_ratio"))


@register("participation_by_class", f"""WITH {_U}, X AS (SELECT coarse, fine, id, i, u[i] - avg(u[i]) OVER (PARTITION BY fine, i) AS x FROM U, range(1, 65) t(i)),
G AS (SELECT p.coarse, p.fine, p.i, q.i AS j, sum(p.x * q.x) AS g FROM X p JOIN X q ON p.fine = q.fine AND p.id = q.id GROUP BY ALL),
R AS (SELECT coarse, fine, pow(sum(CASE WHEN i = j THEN g END), 2) / nullif(sum(g * g), 0) AS pr FROM G GROUP BY ALL) SELECT coarse, round(avg(pr), 5) AS pr_subclass FROM R GROUP BY coarse""")  # fmt: skip
def participation_by_class(spark, sf_dir):
    from strata.operators.sets import participation

    df = unit_rows(spark, sf_dir)
    return participation(df, "fine").join(df.select("fine", "coarse").distinct(), "fine").groupBy("coarse").agg(F.round(F.avg("pr"), 5).alias("pr_subclass"))


@register("knn_accuracy_by_class", f"""WITH {_E}, {_top(20, _TRAIN.format('b') + ' AND NOT ' + _TRAIN.format('a'))}, V AS (SELECT a, ca, fa, fb, count(*) AS n FROM T GROUP BY ALL),
B AS (SELECT ca, fa = fb AS correct FROM V QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, fb) = 1), C AS (SELECT ca, avg(correct::INT) AS m, count(*) AS n FROM B GROUP BY ca)
SELECT ca::VARCHAR AS "group", round(m, 6) AS acc, n FROM C UNION ALL SELECT 'macro', round(avg(m), 6), count(*) FROM C""")  # fmt: skip
def knn_accuracy_by_class(spark, sf_dir):
    df = rows(spark, sf_dir)
    found = similarity.top_k(df.where(~_train()).select("id", "v"), df.where(_train()).select("id", "v"), 20)
    voted = similarity.vote(found, df.select("id", F.col("fine").alias("y"))).join(df.select(F.col("id").alias("a"), "fine", "coarse"), "a")
    table = metrics.point_table(voted.withColumn("acc", F.when(F.col("y") == F.col("fine"), 1.0).otherwise(0.0)), "coarse", ["acc"])
    return table.select("group", F.round("mean", 6).alias("acc"), "n")


@register("linear_probe")
def linear_probe(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", F.col("fine").alias("y"), unit(F.col("v")).alias("u"))
    return spectra.probe(df.where(_train()), df.where(~_train()))


@register("covariance_by_class", f"WITH {_E}, X AS (SELECT coarse, id, i, v[i] AS x FROM E, range(1, 65) t(i)) SELECT p.coarse AS g, (p.i - 1)::INT AS i, (q.i - 1)::INT AS j, round(covar_samp(p.x, q.x), 6) + 0.0 AS cov FROM X p JOIN X q ON p.id = q.id AND p.coarse = q.coarse GROUP BY ALL")
def covariance_by_class(spark, sf_dir):
    return spectra.covariance(rows(spark, sf_dir).select(F.col("coarse").alias("g"), "v")).select("g", "i", "j", *_six("cov"))


@register("principal_scores")
def principal_scores(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", F.col("coarse").alias("g"), unit(F.col("v")).alias("v"))
    return spectra.scores(df, spectra.axes(df, 50), 50)


@register("component_shares", f"""WITH {_E}, X AS (SELECT coarse, i, v[i] AS x FROM E, range(1, 65) t(i)), V AS (SELECT coarse, sum(s) AS t FROM (SELECT coarse, i, var_pop(x) * count(*) AS s FROM X GROUP BY ALL) GROUP BY coarse)
SELECT coarse AS g, round(t, 4) AS total FROM V""")  # fmt: skip
def component_shares(spark, sf_dir):
    found = spectra.axes(rows(spark, sf_dir).select(F.col("coarse").alias("g"), "v"), 64)
    return found.select("g", F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register("standardised", f"""WITH {_E}, X AS (SELECT id, i, v[i] AS x FROM E, range(1, 65) t(i)), S AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM X WHERE {_TRAIN.format('id')} GROUP BY i)
SELECT id, (X.i - 1)::INT AS i, round((x - m) / (s + 1e-6) / 8, 6) + 0.0 AS x FROM X JOIN S ON X.i = S.i WHERE NOT {_TRAIN.format('id')}""")  # fmt: skip
def standardised(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", "v")
    return spectra.standardise(df.where(~_train()), df.where(_train())).select("id", "i", *_six("x"))


@register("residualised", f"""WITH {_E}, X AS (SELECT id, i, v[i] AS y, v[1] AS c FROM E, range(1, 65) t(i)), R AS (SELECT i, regr_slope(y, c) AS b, regr_intercept(y, c) AS a FROM X GROUP BY i)
SELECT id, (X.i - 1)::INT AS i, round(y - a - b * c, 6) + 0.0 AS x FROM X JOIN R ON X.i = R.i WHERE X.i > 1""")  # fmt: skip
def residualised(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", "v", F.get("v", F.lit(0)).cast("double").alias("c"))
    left = spectra.residuals(df, ["c"]).select("id", F.posexplode("v").alias("i", "x"))
    return left.where("i > 0").select("id", "i", (F.round("x", 6) + 0.0).alias("x"))


@register("gram_features", f"WITH {_E} SELECT id, i::INT AS i, j::INT AS j, round(list_inner_product(v[8 * i + 1 : 8 * i + 8], v[8 * j + 1 : 8 * j + 8]) / 8, 6) + 0.0 AS x FROM E, range(0, 8) a(i), range(0, 8) b(j) WHERE i <= j")
def gram_features(spark, sf_dir):
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(8) for j in range(i, 8)])
    df = rows(spark, sf_dir).select("id", F.explode(F.arrays_zip(places.alias("p"), spectra.gram_features(F.col("v"), 8, 8).alias("x"))).alias("e"))
    return df.select("id", "e.p.i", "e.p.j", (F.round("e.x", 6) + 0.0).alias("x"))


@register("weighted_centroids", f"""WITH {_E}, X AS (SELECT fine, i, v[i] AS x, 1 + id % 3 AS w FROM E, range(1, 65) t(i)), S AS (SELECT fine, i, sum(w * x) / sum(w) AS x, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS var FROM X GROUP BY ALL)
SELECT fine, (i - 1)::INT AS i, round(x, 6) + 0.0 AS x, round(var, 6) + 0.0 AS var FROM S""")  # fmt: skip
def weighted_centroids(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("w", 1 + F.col("id") % 3)
    return spectra.weighted_centroids(df, "fine", "w").select("fine", "i", *_six("x", "var"))


@register("weighted_trace", f"""WITH {_E}, X AS (SELECT fine, i, v[i] AS x, 1 + id % 3 AS w FROM E, range(1, 65) t(i)), S AS (SELECT fine, i, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS var FROM X GROUP BY ALL)
SELECT fine, round(sum(var), 6) AS trace FROM S GROUP BY fine""")  # fmt: skip
def weighted_trace(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("w", 1 + F.col("id") % 3)
    return spectra.weighted_centroids(df, "fine", "w").groupBy("fine").agg(F.round(F.sum("var"), 6).alias("trace"))


@register("nearest_to_support", f"""WITH {_U}, M0 AS (SELECT fine, i, avg(u[i]) AS x FROM U, range(1, 65) t(i) WHERE id % 10 = 1 GROUP BY ALL), M AS (SELECT fine, list(x ORDER BY i) AS m FROM M0 GROUP BY fine)
SELECT M.fine, id, row_number() OVER (PARTITION BY M.fine ORDER BY round(list_cosine_similarity(u, m), 9) DESC, id) AS place FROM M, U WHERE id % 10 = 2 QUALIFY place <= 5""")  # fmt: skip
def nearest_to_support(spark, sf_dir):
    df = unit_rows(spark, sf_dir)
    means = df.where("id % 10 = 1").select("fine", F.posexplode("u").alias("i", "x")).groupBy("fine", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("fine").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    found = similarity.top_k(means.select((-1 - F.col("fine").cast("long")).alias("id"), "v"), df.where("id % 10 = 2").select("id", F.col("u").alias("v")), 5)
    return found.select((-1 - F.col("a")).cast("int").alias("fine"), F.col("b").alias("id"), F.col("rank").cast("long").alias("place"))


_PROTO = """C AS (SELECT fine, coarse, list(x ORDER BY i) AS c FROM (SELECT fine, coarse, i, avg(v[i]) AS x FROM E, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL),
O AS (SELECT id, E.coarse, E.fine AS y, C.fine AS c, list_cosine_similarity(v, C.c) AS s, list_cosine_similarity(list_reverse(v), C.c) AS f FROM E JOIN C ON E.coarse = C.coarse)"""


def _assigned(spark, sf_dir):
    """(id, coarse, y, c, flip): the own class's nearest prototype of each row and of its mirror image, here the reversed vector."""
    df = rows(spark, sf_dir)
    parts = df.select("fine", "coarse", F.posexplode("v").alias("i", "x")).groupBy("fine", "coarse", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col("fine").alias("c"), "coarse").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    scored = df.join(F.broadcast(means), "coarse").select("id", "coarse", F.col("fine").alias("y"), "c", F.round(cosine(F.col("v"), F.col("m")), 9).alias("s"), F.round(cosine(F.reverse("v"), F.col("m")), 9).alias("f"))
    first = lambda by: F.max_by("c", F.struct(by, (-F.col("c")).alias("low")))
    return scored.groupBy("id", "coarse", "y").agg(first("s").alias("c"), first("f").alias("flip"))


def _agreement_sql(table: str, y: str, c: str) -> str:
    pairs = "sum(n * (n - 1) / 2)"
    side = lambda x: f"(SELECT coarse, {pairs} AS p, sum(n * ln(n)) AS h FROM (SELECT coarse, {x}, count(*)::DOUBLE AS n FROM {table} GROUP BY ALL) GROUP BY coarse)"
    both = f"(SELECT coarse, {pairs} AS p, sum(n * ln(n)) AS h, sum(n) AS t FROM (SELECT coarse, {y}, {c}, count(*)::DOUBLE AS n FROM {table} GROUP BY ALL) GROUP BY coarse)"
    return f"""(SELECT j.coarse, t, (j.p - a.p * b.p / nullif(t * (t - 1) / 2, 0)) / nullif((a.p + b.p) / 2 - a.p * b.p / nullif(t * (t - 1) / 2, 0), 0) AS ari,
 ((ln(t) - a.h / t) + (ln(t) - b.h / t) - (ln(t) - j.h / t)) / nullif(((ln(t) - a.h / t) + (ln(t) - b.h / t)) / 2, 0) AS nmi FROM {both} j JOIN {side(y)} a USING (coarse) JOIN {side(c)} b USING (coarse))"""


@register("assignment_agreement", f"""WITH {_E}, {_PROTO}, B AS (SELECT id, coarse, y, first(c ORDER BY round(s, 9) DESC, c) AS c, first(c ORDER BY round(f, 9) DESC, c) AS flip FROM O GROUP BY ALL)
SELECT a.coarse, a.t::BIGINT AS n, round(a.ari, 6) AS ari, round(a.nmi, 6) AS nmi, round(f.ari, 6) AS flip_ari FROM {_agreement_sql('B', 'y', 'c')} a JOIN {_agreement_sql('B', 'c', 'flip')} f USING (coarse)""")  # fmt: skip
def assignment_agreement(spark, sf_dir):
    own = _assigned(spark, sf_dir)
    flip = metrics.agreement_by(own, "coarse", "c", "flip").select("coarse", F.col("ari").alias("flip_ari"))
    return metrics.agreement_by(own, "coarse", "y", "c").join(flip, "coarse").select("coarse", "n", *_six("ari", "nmi", "flip_ari"))


@register("assignment_accuracy")
def assignment_accuracy(spark, sf_dir):
    return clustering.clustering_accuracy(_assigned(spark, sf_dir), "y", "c")


def _space(spark, sf_dir):
    """(id, g, v): rows on the five leading axes of their coarse class, where clusters are looked for."""
    df = rows(spark, sf_dir).select("id", F.col("coarse").alias("g"), unit(F.col("v")).alias("v"))
    return spectra.scores(df, spectra.axes(df, 5), 5)


@register("label_free_k")
def label_free_k(spark, sf_dir):
    chosen = clusterings.choose_k(_space(spark, sf_dir))
    kinds = rows(spark, sf_dir).groupBy(F.col("coarse").cast("long").alias("coarse")).agg(F.count_distinct("fine").alias("k_c"))
    found = spark.createDataFrame([(g, k, how) for g, (k, how) in sorted(chosen.items())], "coarse long, khat int, how string")
    return found.join(kinds, "coarse").select("coarse", "khat", "how", "k_c", (F.col("khat") - F.col("k_c")).alias("khat_error"))


@register("clustering_by_class")
def clustering_by_class(spark, sf_dir):
    """ACC, NMI and ARI of k-means with as many clusters as the class has fine classes, and how stable it is over seeds and resamples."""
    df, space = rows(spark, sf_dir), _space(spark, sf_dir)
    k_of = {r["coarse"]: r["k"] for r in df.groupBy("coarse").agg(F.count_distinct("fine").alias("k")).collect()}
    labelled = settled(clusterings.stability_labels(space, k_of).join(df.select("id", "fine", "coarse"), "id"))
    at = lambda i: F.get("labels", F.lit(i))
    runs = [("ari_seeds", a, b) for a, b in itertools.combinations(range(3), 2)] + [("ari_boot", 0, b) for b in range(3, 23)]
    both = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("run"), at(a).alias("x"), at(b).alias("y")) for i, (name, a, b) in enumerate(runs)])
    compared = labelled.select("coarse", F.explode(both).alias("p")).select(F.struct("coarse", "p.name", "p.run").alias("key"), "p.x", "p.y")
    each = metrics.agreement_by(compared, "key", "x", "y").groupBy("key.coarse").pivot("key.name", ["ari_seeds", "ari_boot"]).agg(F.avg("ari"))
    own = metrics.agreement_by(labelled.withColumn("c", at(0)), "coarse", "fine", "c").select("coarse", "n", "ari", "nmi")
    return own.join(each, "coarse", "left")


@register("knn_graph_weights", f"""WITH {_E}, {_top(5)}, S AS (SELECT a, sqrt(greatest(max(2 - 2 * sim), 0)) AS s FROM T GROUP BY a),
W AS (SELECT T.a, T.b, exp(-greatest(2 - 2 * sim, 0) / greatest(x.s * y.s, 1e-12)) AS w FROM T JOIN S x ON x.a = T.a JOIN S y ON y.a = T.b), B AS (SELECT a, b, w FROM W UNION ALL SELECT b, a, w FROM W) SELECT a, b, round(max(w), 6) AS w FROM B GROUP BY a, b""")  # fmt: skip
def knn_graph_weights(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.weighted_graph(similarity.top_k(side, side, 5), 5).select("a", "b", *_six("w"))


@register("explained_by_covariates")
def explained_by_covariates(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", F.col("coarse").alias("g"), "v", F.get("v", F.lit(0)).cast("double").alias("c0"), F.get("v", F.lit(1)).cast("double").alias("c1"))
    return spectra.explained_share(df, ["c0", "c1"])


@register("shuffled_within_class", f"""WITH {_E}, A AS (SELECT id, coarse, row_number() OVER (PARTITION BY coarse ORDER BY md5('0:to:' || id), id) AS p FROM E), B AS (SELECT id, coarse, row_number() OVER (PARTITION BY coarse ORDER BY md5('0:from:' || id), id) AS p FROM E)
SELECT A.id, A.coarse, B.id AS taken FROM A JOIN B USING (coarse, p)""")  # fmt: skip
def shuffled_within_class(spark, sf_dir):
    """Which row of its coarse class each row takes its covariates from in the shuffled control."""
    df = rows(spark, sf_dir).select("id", F.col("coarse").alias("g"), F.col("id").alias("taken"))
    return nuisance.shuffled(df, ["taken"]).select("id", F.col("g").alias("coarse"), "taken")


@register("nuisance_summary")
def nuisance_summary(spark, sf_dir):
    """The shares of a class's components that two of its own coordinates and two that say nothing tell, with the shuffled control, averaged over coarse classes."""
    told = [F.get("v", F.lit(i)).cast("double").alias(f"c{i}") for i in range(2)]
    noise = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0).alias(f"x{i}") for i in range(2)]
    df = rows(spark, sf_dir).select("id", F.col("coarse").alias("g"), "v", *told, *noise)
    found = nuisance.table(df, {"told": ["c0", "c1"], "noise": ["x0", "x1"]}, control="told")
    return nuisance.summary(found).select("metric", *_six("mean", "lo", "hi"), "n", "band")
