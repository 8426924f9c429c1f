"""Registered queries of resampled measures, of communities and diffusion maps of the neighbour graph, and of how normal embeddings are."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import communities, diffusion, losses, resampling, similarity
from strata.operators.durable import settled
from strata.operators.resampling import draws_sql

from .embedding_queries import _E, rows
from .registry import register

_X, _Y = "v[1]", "v[2]"


@register("bootstrap_correlation", f"""WITH {_E}, S AS (SELECT coarse, b, sum(w) AS n, sum(w * {_X}) AS x, sum(w * {_Y}) AS y, sum(w * {_X} * {_X}) AS xx, sum(w * {_Y} * {_Y}) AS yy, sum(w * {_X} * {_Y}) AS xy FROM (SELECT E.*, b, {draws_sql("id", "b", 7)} AS w FROM E, range(0, 1001) t(b)) GROUP BY ALL),
M AS (SELECT coarse::VARCHAR AS grp, b, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS r FROM S), A AS (SELECT * FROM M UNION ALL SELECT 'macro', b, avg(r) FROM M GROUP BY b), C AS (SELECT coarse::VARCHAR AS grp, count(*) AS n FROM E GROUP BY 1), N AS (SELECT * FROM C UNION ALL SELECT 'macro', count(*) FROM C)
SELECT grp AS "group", 'correlation' AS metric, round(max(CASE WHEN b = 0 THEN r END), 6) AS mean, round(quantile_cont(CASE WHEN b > 0 THEN r END, 0.025), 6) AS lo, round(quantile_cont(CASE WHEN b > 0 THEN r END, 0.975), 6) AS hi, max(n) AS n FROM A JOIN N USING (grp) GROUP BY grp""")  # fmt: skip
def bootstrap_correlation(spark, sf_dir):
    """How the first two components go together in each coarse class: a measure that is no mean, with its interval."""
    pairs = rows(spark, sf_dir).select("id", "coarse", *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")])
    table = resampling.intervals(pairs, "coarse", "id", resampling.correlation_of("x", "y"), ["x", "y"], seed=7)
    return table.select("group", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n")


def _graph(spark, sf_dir, k: int):
    """(g, a, b, w): the symmetric neighbour graph of each coarse class."""
    df = rows(spark, sf_dir)
    side = df.select("id", "v", F.col("coarse").alias("g"))
    return similarity.weighted_graph(similarity.top_k(side, side, k), k).join(df.select(F.col("id").alias("a"), F.col("coarse").cast("long").alias("g")), "a").select("g", "a", "b", "w")


@register("modularity_by_class", f"""WITH {_E}, T AS (SELECT a, b, ca, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM P WHERE ca = cb QUALIFY rank <= 5), S AS (SELECT a, sqrt(greatest(max(2 - 2 * sim), 0)) AS s FROM T GROUP BY a),
D AS (SELECT T.a, T.b, T.ca, exp(-greatest(2 - 2 * sim, 0) / greatest(x.s * y.s, 1e-12)) AS w FROM T JOIN S x ON x.a = T.a JOIN S y ON y.a = T.b), B AS (SELECT ca AS g, a, b, max(w) AS w FROM (SELECT * FROM D UNION ALL SELECT b, a, ca, w FROM D) GROUP BY ALL),
C AS (SELECT g, x.fine AS c, sum(w) AS k, sum(CASE WHEN x.fine = y.fine THEN w ELSE 0 END) AS i FROM B JOIN E x ON x.id = a JOIN E y ON y.id = b GROUP BY ALL) SELECT g AS coarse, round(sum(i) / sum(k) - sum(k * k) / pow(sum(k), 2), 6) AS q FROM C GROUP BY g""")  # fmt: skip
def modularity_by_class(spark, sf_dir):
    """The modularity of the fine classes on the neighbour graph of each coarse class."""
    labels = rows(spark, sf_dir).select(F.col("coarse").cast("long").alias("g"), "id", F.col("fine").alias("c"))
    return communities.modularity(settled(_graph(spark, sf_dir, 5)), labels).select(F.col("g").cast("int").alias("coarse"), F.round("q", 6).alias("q"))


@register("diffusion_clusters")
def diffusion_clusters(spark, sf_dir):
    """Clusters of each coarse class on the diffusion map of its neighbour graph, as many as its greatest eigengap says."""
    return diffusion.clusters(_graph(spark, sf_dir, 15)).select("id", F.col("g").cast("int").alias("coarse"), "k", F.col("c").alias("cluster"))


_NORMAL = """A AS (SELECT {g}, s, list_inner_product(v, d) AS x FROM {rows}, D), C AS (SELECT {g}, s, k, count(*) AS n, avg(cos(x * (k * 0.625 - 5))) AS c, avg(sin(x * (k * 0.625 - 5))) AS i FROM A, range(17) p(k) GROUP BY ALL),
S AS (SELECT {g}, s, max(n) AS n, max(n) * sum((pow(c - exp(-pow(k * 0.625 - 5, 2) / 2), 2) + i * i) * exp(-pow(k * 0.625 - 5, 2) / 2) * CASE WHEN k IN (0, 16) THEN 0.3125 ELSE 0.625 END) AS x FROM C GROUP BY ALL), N AS (SELECT {g}, max(n) AS n, avg(x) AS sigreg FROM S GROUP BY {g})"""


@register("normality_by_class", f"""WITH {_E}, D AS ({losses.directions_sql(64, 128)}), R AS (SELECT coarse, list_transform(v, lambda x: 8 * x) AS v FROM E), {_NORMAL.format(g="coarse", rows="R")} SELECT coarse::VARCHAR AS coarse, n, round(sigreg, 6) AS sigreg FROM N""")
def normality_by_class(spark, sf_dir):
    """How far each coarse class is from an isotropic normal distribution, along 128 directions; vectors are times eight, the root of their length."""
    scaled = rows(spark, sf_dir).select("coarse", F.transform("v", lambda x: 8 * x.cast("double")).alias("v"))
    return losses.normality(scaled, "coarse", slices=128).select("coarse", "n", F.round("sigreg", 6).alias("sigreg"))


@register("joint_embedding", f"""WITH {_E}, D AS ({losses.directions_sql(64, 128)}), R AS (SELECT id, view, list_transform(CASE WHEN view = 0 THEN v ELSE list_reverse(v) END, lambda x: 8 * x) AS v FROM E, range(2) w(view)), {_NORMAL.format(g="view", rows="R")},
I AS (SELECT avg(x) AS invariance FROM (SELECT pow(v[i] - avg(v[i]) OVER (PARTITION BY id, i), 2) AS x FROM R, range(1, 65) t(i))) SELECT round(0.95 * invariance + 0.05 * (SELECT avg(sigreg) FROM N), 6) AS loss, round(invariance, 6) AS invariance, (SELECT round(avg(sigreg), 6) FROM N) AS sigreg FROM I""")  # fmt: skip
def joint_embedding(spark, sf_dir):
    """Invariance of two views, the vector and its mirror image, and the normality of each."""
    df = rows(spark, sf_dir)
    views = df.select("id", F.lit(0).alias("view"), "v").unionByName(df.select("id", F.lit(1).alias("view"), F.reverse("v").alias("v")))
    found = losses.joint_embedding(views.withColumn("v", F.transform("v", lambda x: 8 * x.cast("double"))), slices=128)
    return found.select(*[F.round(c, 6).alias(c) for c in ("loss", "invariance", "sigreg")])
