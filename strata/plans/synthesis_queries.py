"""Registered queries that hold a generated set against a real one. Rows of ``embeddings`` whose id leaves 0, 1 or 2 modulo 3 stand for
the generated, test and train sides; the softmax of eight times the first ten components stands for the evaluator's probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import labels, metrics, synthesis

from .embedding_queries import _E, rows
from .registry import register

TAU = 0.2
_Q = f"""WITH {_E}, D AS (SELECT DISTINCT coarse, fine FROM E),
Q0 AS (SELECT id, fine, coarse, v, CASE WHEN id % 15 = 0 THEN (coarse + 1) % 4 ELSE coarse END AS req, list_transform(v[1:10], lambda x: exp(8 * x)) AS e FROM E),
Q AS (SELECT *, list_position(e, list_max(e)) - 1 AS pred, list_max(e) / list_sum(e) AS conf FROM Q0),
G AS (SELECT * FROM Q WHERE id % 3 = 0), T AS (SELECT * FROM Q WHERE id % 3 = 1), N AS (SELECT * FROM Q WHERE id % 3 = 2),
A AS (SELECT G.id, G.req, G.v, d.fine FROM G JOIN D d ON d.coarse = G.req QUALIFY row_number() OVER (PARTITION BY G.id ORDER BY e[d.fine + 1] DESC, d.fine) = 1)"""


def evaluated(spark, sf_dir):
    """(id, fine, coarse, v, probs, pred, conf, requested coarse as req)."""
    df = rows(spark, sf_dir).withColumn("probs", synthesis.softmax(F.transform(F.slice("v", 1, 10), lambda x: 8 * x.cast("double"))))
    df = df.withColumn("pred", synthesis.argmax(F.col("probs"))).withColumn("conf", F.array_max("probs"))
    return df.withColumn("req", F.when(F.col("id") % 15 == 0, (F.col("coarse") + 1) % 4).otherwise(F.col("coarse")))


def classes_of(spark, sf_dir):
    return rows(spark, sf_dir).select("coarse", "fine").distinct()


def _six(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]  # no minus zero


def _side(df, rest: int):
    return df.where(F.col("id") % 3 == rest)


@register("requested_accuracy", f"{_Q} SELECT req AS coarse, round(avg(CASE WHEN d.coarse = req THEN 1.0 ELSE 0.0 END), 6) AS acc, count(*) AS n FROM G JOIN D d ON d.fine = pred GROUP BY req")
def requested_accuracy(spark, sf_dir):
    of = classes_of(spark, sf_dir).select(F.col("fine").alias("pred"), F.col("coarse").alias("pred_coarse"))
    made = _side(evaluated(spark, sf_dir), 0).join(F.broadcast(of), "pred")
    return made.groupBy(F.col("req").alias("coarse")).agg(F.round(F.avg(F.when(F.col("pred_coarse") == F.col("req"), 1.0).otherwise(0.0)), 6).alias("acc"), F.count("*").alias("n"))


@register("restricted_prediction", f"{_Q} SELECT id, req, fine FROM A")
def restricted_prediction(spark, sf_dir):
    made = _side(evaluated(spark, sf_dir), 0).select("id", F.col("req").alias("coarse"), "probs")
    return synthesis.restricted_argmax(made, classes_of(spark, sf_dir)).select("id", F.col("coarse").alias("req"), "fine")


@register("subclass_gap_by_class", f"""{_Q}, H AS (SELECT coarse, fine, (SELECT count(*) FROM A WHERE A.req = D.coarse AND A.fine = D.fine) AS p, (SELECT count(*) FROM T WHERE T.fine = D.fine) AS q FROM D),
S AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS tq, count(*) OVER w AS k FROM H WINDOW w AS (PARTITION BY coarse))
SELECT coarse, round(sum(abs(p / tp - q / tq)) / 2, 6) AS tv, round(sum((q + 1) / (tq + k) * ln((q + 1) / (tq + k) / ((p + 1) / (tp + k)))), 6) AS kl FROM S GROUP BY coarse""")  # fmt: skip
def subclass_gap_by_class(spark, sf_dir):
    predicted = restricted_prediction(spark, sf_dir).select(F.col("req").alias("coarse"), "fine")
    gap = synthesis.class_gap(predicted, _side(rows(spark, sf_dir), 1).select("fine"), classes_of(spark, sf_dir))
    return gap.select("coarse", *_six("tv", "kl"))


@register("evaluator_agreement", f"{_Q} SELECT count(*) AS n, round(avg(CASE WHEN pred = fine THEN 1.0 ELSE 0.0 END), 6) AS acc, round(avg(conf), 6) AS mean_conf, round(avg(CASE WHEN conf >= {TAU} THEN 1.0 ELSE 0.0 END), 6) AS frac_confident, round(avg(CASE WHEN conf >= {TAU} AND pred = fine THEN 1.0 ELSE 0.0 END), 6) AS frac_confident_correct FROM G")
def evaluator_agreement(spark, sf_dir):
    found = synthesis.evaluator_agreement(_side(evaluated(spark, sf_dir), 0).withColumn("requested", F.col("fine")), TAU)
    return found.select("n", *_six("acc", "mean_conf", "frac_confident", "frac_confident_correct"))


_KID = "pow(list_inner_product(x.v, y.v) / 64 + 1, 3)"


def _kid_sql(x: str, y: str, g: str = "g") -> str:
    """SQL: (g, kid) of two CTEs (id, v, g)."""
    mean = lambda a, b: f"(SELECT x.{g} AS g, avg({_KID}) AS m FROM {a} x JOIN {b} y ON x.{g} = y.{g} AND x.id <> y.id GROUP BY x.{g})"
    return f"(SELECT xx.g, xx.m + yy.m - 2 * xy.m AS kid FROM {mean(x, x)} xx JOIN {mean(y, y)} yy ON xx.g = yy.g JOIN {mean(x, y)} xy ON xx.g = xy.g)"


def _coverage_sql(real: str, made: str, k: int) -> str:
    """SQL: (g, coverage) of two CTEs (id, v, g)."""
    d = "sqrt(list_sum(list_transform(x.v, lambda a, i: (a - y.v[i]) * (a - y.v[i]))))"
    radius = f"(SELECT x.id, x.g, {d} AS r FROM {real} x JOIN {real} y ON x.g = y.g AND x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.g, x.id ORDER BY {d}) = {k})"
    nearest = f"(SELECT x.id, x.g, min({d}) AS m FROM {real} x JOIN {made} y ON x.g = y.g GROUP BY x.g, x.id)"
    enough = f"(SELECT g FROM {real} GROUP BY g HAVING count(*) > {k} INTERSECT SELECT g FROM {made} GROUP BY g HAVING count(*) > {k})"
    return f"(SELECT r.g, avg(CASE WHEN m <= r THEN 1.0 ELSE 0.0 END) AS coverage FROM {radius} r JOIN {nearest} n ON r.g = n.g AND r.id = n.id JOIN {enough} e ON e.g = r.g GROUP BY r.g)"


_FIDELITY = f"""{_Q}, X AS (SELECT G.id, G.v, G.pred AS g FROM G JOIN D d ON d.fine = pred AND d.coarse = req WHERE conf >= {TAU}), C AS (SELECT d.fine AS g, count(X.id) AS n FROM D d LEFT JOIN X ON X.g = d.fine GROUP BY d.fine),
XC AS (SELECT X.* FROM X JOIN C ON X.g = C.g WHERE n >= 5), Y AS (SELECT id, v, fine AS g FROM T),
Z AS (SELECT N.id, N.v, N.fine AS g FROM N JOIN C ON N.fine = C.g WHERE C.n >= 5 QUALIFY row_number() OVER (PARTITION BY N.fine ORDER BY md5('0:' || N.id), N.id) <= C.n),
RT AS (SELECT d.fine AS g, count(N.id) <= (SELECT quantile_cont(n, 0.25) FROM (SELECT count(N.id) AS n FROM D d LEFT JOIN N ON N.fine = d.fine GROUP BY d.fine)) AS rare FROM D d LEFT JOIN N ON N.fine = d.fine GROUP BY d.fine),
F AS (SELECT C.g, D.coarse, RT.rare, n, n >= 5 AS covered, k1.kid, c1.coverage, k2.kid AS kid_ceiling, c2.coverage AS coverage_ceiling FROM C JOIN D ON D.fine = C.g JOIN RT ON RT.g = C.g
 LEFT JOIN {_kid_sql('XC', 'Y')} k1 ON k1.g = C.g LEFT JOIN {_coverage_sql('Y', 'XC', 3)} c1 ON c1.g = C.g LEFT JOIN {_kid_sql('Z', 'Y')} k2 ON k2.g = C.g LEFT JOIN {_coverage_sql('Y', 'Z', 3)} c2 ON c2.g = C.g)"""


def _fidelity(spark, sf_dir):
    df, classes = evaluated(spark, sf_dir), classes_of(spark, sf_dir)
    own = classes.select(F.col("fine").alias("pred"), F.col("coarse").alias("req"))
    made = _side(df, 0).where(F.col("conf") >= TAU).join(F.broadcast(own), ["pred", "req"]).select("id", "v", F.col("pred").alias("g"))
    test, train = (_side(df, r).select("id", "v", F.col("fine").alias("g")) for r in (1, 2))
    table = synthesis.class_fidelity(made, test, train, classes.select(F.col("fine").alias("g")))
    counts = labels.zero_filled_counts(train.select(F.col("g").alias("fine")), classes, "fine")
    rare = counts.crossJoin(F.broadcast(counts.agg(F.percentile("n", F.lit(0.25)).alias("q"))))  # one row
    rare = rare.select(F.col("fine").alias("g"), (F.col("n") <= F.col("q")).alias("rare"))
    return table.join(F.broadcast(classes.select(F.col("fine").alias("g"), "coarse")), "g").join(F.broadcast(rare), "g")


@register("class_fidelity", f"{_FIDELITY} SELECT coarse, g AS fine, rare, n, covered, round(kid, 5) + 0.0 AS kid, round(coverage, 5) AS coverage, round(kid_ceiling, 5) + 0.0 AS kid_ceiling, round(coverage_ceiling, 5) AS coverage_ceiling FROM F")
def class_fidelity(spark, sf_dir):
    return _fidelity(spark, sf_dir).select("coarse", F.col("g").alias("fine"), "rare", "n", "covered", *[(F.round(c, 5) + 0.0).alias(c) for c in ("kid", "coverage", "kid_ceiling", "coverage_ceiling")])


@register("class_fidelity_summary", f"""{_FIDELITY} SELECT coarse, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 5) AS frac_covered, round(avg(CASE WHEN rare THEN covered::INT::DOUBLE END), 5) AS frac_rare_covered,
 round(avg(CASE WHEN NOT rare THEN covered::INT::DOUBLE END), 5) AS frac_common_covered, round(avg(kid), 5) + 0.0 AS kid, round(avg(kid) - avg(kid_ceiling), 5) + 0.0 AS kid_excess, round(avg(coverage), 5) AS coverage FROM F GROUP BY coarse""")  # fmt: skip
def class_fidelity_summary(spark, sf_dir):
    found = synthesis.fidelity_summary(_fidelity(spark, sf_dir), ["coarse"])
    names = ("frac_covered", "frac_rare_covered", "frac_common_covered", "kid", "kid_excess", "coverage")
    return found.select("coarse", *[(F.round(c, 5) + 0.0).alias(c) for c in names])  # no minus zero


@register("kid_subsets", f"""{_Q}, S AS (SELECT id, v, b AS g, side FROM (SELECT id, v, 0 AS side FROM G UNION ALL SELECT id, v, 1 FROM T), range(4) t(b) QUALIFY row_number() OVER (PARTITION BY b, side ORDER BY md5('3:' || b || ':' || id), id) <= 60),
X AS (SELECT * FROM S WHERE side = 0), Y AS (SELECT * FROM S WHERE side = 1) SELECT round(avg(kid), 6) + 0.0 AS kid FROM {_kid_sql('X', 'Y')}""")  # fmt: skip
def kid_subsets(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", "v")
    return synthesis.kid_subsets(_side(df, 0), _side(df, 1), 4, 60, 3).select(*_six("kid"))


def _grouped(spark, sf_dir):
    """Generated rows with a made-up group, four in each requested class."""
    return _side(evaluated(spark, sf_dir), 0).withColumn("grp", F.col("req") * 4 + F.col("id") % 4)


_COST = f"""{_Q}, X AS (SELECT id, v, req, req * 4 + id % 4 AS g FROM G), Y AS (SELECT id, v, coarse, fine AS g FROM T),
XX AS (SELECT x.g, avg({_KID}) AS m FROM X x JOIN X y ON x.g = y.g AND x.id <> y.id GROUP BY x.g), YY AS (SELECT x.g, avg({_KID}) AS m FROM Y x JOIN Y y ON x.g = y.g AND x.id <> y.id GROUP BY x.g),
XY AS (SELECT x.req, x.g, y.g AS fine, avg({_KID}) AS m FROM X x JOIN Y y ON x.req = y.coarse GROUP BY ALL)"""


@register("group_match_costs", f"{_COST} SELECT req AS g, XY.g AS grp, fine, round(XX.m + YY.m - 2 * XY.m, 6) + 0.0 AS kid FROM XY JOIN XX ON XX.g = XY.g JOIN YY ON YY.g = XY.fine")
def group_match_costs(spark, sf_dir):
    return _costs(spark, sf_dir).select("g", "grp", "fine", *_six("kid"))


def _costs(spark, sf_dir):
    made = _grouped(spark, sf_dir).select("id", "v", F.col("req").alias("g"), F.col("grp").alias("group"))
    real = _side(rows(spark, sf_dir), 1).select("id", "v", F.col("coarse").alias("g"), F.col("fine").alias("group"))
    return synthesis.group_costs(made, real)


@register("group_match")
def group_match(spark, sf_dir):
    return synthesis.match_groups(_costs(spark, sf_dir))


@register("group_purity", f"""{_Q}, K AS (SELECT req AS g, req * 4 + A.id % 4 AS grp, fine, count(*) AS n FROM A GROUP BY ALL), W AS (SELECT *, n / sum(n) OVER (PARTITION BY g, grp) AS p, sum(n) OVER (PARTITION BY g, grp) AS size FROM K),
R AS (SELECT g, grp, max(p) AS purity, -sum(p * ln(p)) AS entropy FROM W WHERE size >= 2 GROUP BY ALL) SELECT g, round(avg(purity), 6) AS purity, round(avg(entropy), 6) AS entropy, count(*) AS n_groups FROM R GROUP BY g""")  # fmt: skip
def group_purity(spark, sf_dir):
    made = _grouped(spark, sf_dir).select("grp", F.col("req").alias("coarse"), "probs")
    found = synthesis.group_purity(synthesis.restricted_argmax(made, classes_of(spark, sf_dir)).withColumnRenamed("coarse", "g"))
    return found.select("g", *_six("purity", "entropy"), "n_groups")


@register("calibrated_confidence", f"{_Q} SELECT id, round(conf, 6) AS conf, pred FROM Q")
def calibrated_confidence(spark, sf_dir):
    return evaluated(spark, sf_dir).select("id", *_six("conf"), "pred")


@register("fidelity_knn_balls", f"""{_Q}, M AS (SELECT x.id AS a, y.id AS b, x.id % 3 AS s, y.id % 3 AS t, sqrt(list_sum(list_transform(x.v, lambda u, i: (u - y.v[i]) * (u - y.v[i])))) AS d FROM E x JOIN E y ON x.id <> y.id WHERE x.id % 3 < 2 AND y.id % 3 < 2),
R AS (SELECT a, s, d AS r FROM M WHERE s = t QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 5),
I AS (SELECT M.a, M.s, count_if(d <= q.r) AS n, bool_or(d <= o.r) AS own FROM M JOIN R q ON q.a = M.b JOIN R o ON o.a = M.a WHERE M.s <> M.t GROUP BY ALL)
SELECT round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) FILTER (s = 0), 6) AS precision, round(avg(n) FILTER (s = 0) / 5, 6) AS density, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) FILTER (s = 1), 6) AS recall,
 round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END) FILTER (s = 1), 6) AS coverage FROM I""")  # fmt: skip
def fidelity_knn_balls(spark, sf_dir):
    from strata.operators.sets import precision_recall

    df = rows(spark, sf_dir).select("id", "v")
    return precision_recall(_side(df, 1), _side(df, 0), 5).select(*_six("precision", "density", "recall", "coverage"))


@register("kth_radius", f"""WITH {_E}, M AS (SELECT x.id, sqrt(list_sum(list_transform(x.v, lambda u, i: (u - y.v[i]) * (u - y.v[i])))) AS d FROM E x JOIN E y ON x.id <> y.id)
SELECT id, round(d, 6) AS r FROM M QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 5""")  # fmt: skip
def kth_radius(spark, sf_dir):
    from strata.operators.sets import radii

    return radii(rows(spark, sf_dir).select("id", "v"), 5).select("id", *_six("r"))


@register("prevalence_by_class", f"{_Q} SELECT D.coarse, D.fine, (SELECT count(*) FROM A WHERE A.fine = D.fine) AS generated, (SELECT count(*) FROM T WHERE T.fine = D.fine) AS test FROM D")
def prevalence_by_class(spark, sf_dir):
    p = restricted_prediction(spark, sf_dir).groupBy("fine").agg(F.count("*").alias("generated"))
    q = _side(rows(spark, sf_dir), 1).groupBy("fine").agg(F.count("*").alias("test"))
    return classes_of(spark, sf_dir).join(p, "fine", "left").join(q, "fine", "left").na.fill(0, ["generated", "test"]).select("coarse", "fine", "generated", "test")


@register("without_ci", f"""WITH {_E}, C AS (SELECT coarse, avg(v[1]) AS a, avg(v[2]) AS b, count(*) AS n FROM E GROUP BY coarse), L AS (SELECT coarse::VARCHAR AS "group", 'a' AS metric, a AS mean, n FROM C UNION ALL SELECT coarse::VARCHAR, 'b', b, n FROM C
 UNION ALL SELECT 'macro', 'a', (SELECT avg(a) FROM C), (SELECT count(*) FROM C) UNION ALL SELECT 'macro', 'b', (SELECT avg(b) FROM C), (SELECT count(*) FROM C)) SELECT "group", metric, round(mean, 6) AS mean, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, n FROM L""")  # fmt: skip
def without_ci(spark, sf_dir):
    df = rows(spark, sf_dir).select("coarse", *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate("ab")])
    return metrics.point_table(df, "coarse", ["a", "b"]).withColumn("mean", F.round("mean", 6))
