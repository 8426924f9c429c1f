"""Registered queries over ``embeddings``: fine = label, coarse = a fixed grouping of it (one, two, three and four labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.vectors import unit
from strata.operators import labels, metrics, similarity

from .registry import register, table

COARSE = "CASE WHEN label = 0 THEN 0 WHEN label <= 2 THEN 1 WHEN label <= 5 THEN 2 ELSE 3 END"
_E = """E AS (SELECT vec_id AS id, label AS fine, CASE WHEN label = 0 THEN 0 WHEN label <= 2 THEN 1 WHEN label <= 5 THEN 2 ELSE 3 END AS coarse,
  embedding::DOUBLE[] AS v FROM embeddings),
P AS (SELECT a.id AS a, b.id AS b, a.fine AS fa, b.fine AS fb, a.coarse AS ca, b.coarse AS cb, list_cosine_similarity(a.v, b.v) AS sim FROM E a JOIN E b ON a.id <> b.id)"""
_TRAIN = "substr(md5(CAST({} AS VARCHAR)), 1, 1) < '8'"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("fine"), F.expr(COARSE).alias("coarse"), F.col("embedding").alias("v"))


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("id", "fine", "coarse", unit(F.col("v")).alias("u"))


@register("group_count_labels", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def group_count_labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@register("hierarchy_k_c", f"WITH {_E}, G AS (SELECT coarse, fine, count(*) AS n FROM E GROUP BY ALL) SELECT coarse, fine, n, count(*) OVER (PARTITION BY coarse) AS k_c FROM G")
def hierarchy_k_c(spark, sf_dir):
    return labels.hierarchy(rows(spark, sf_dir), "coarse", "fine")


@register("subclass_dimension", f"WITH {_E}, G AS (SELECT coarse, fine, count(*) AS n FROM E GROUP BY ALL) SELECT coarse, count(*) AS k_c, sum(n)::BIGINT AS n, string_agg(fine::VARCHAR, ' ' ORDER BY fine) AS members FROM G GROUP BY coarse")
def subclass_dimension(spark, sf_dir):
    return labels.subclass_table(rows(spark, sf_dir), "coarse", "fine")


@register("stratified_split", f"""WITH {_E}, R AS (SELECT id, fine, row_number() OVER (PARTITION BY fine ORDER BY md5('7:' || id), id) AS place, count(*) OVER (PARTITION BY fine) AS n FROM E)
SELECT id, fine, CASE WHEN place <= round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM R""")  # fmt: skip
def stratified_split(spark, sf_dir):
    return labels.stratified_split(rows(spark, sf_dir), "id", "fine", 0.1, 7, ("val", "train"))


@register("similarity_pairs", f"WITH {_E} SELECT a, b, round(sim, 6) AS sim FROM P WHERE a < b AND sim >= 0.4")
def similarity_pairs(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.pairs_over(side, side, 0.4).where("a < b").select("a", "b", F.round("sim", 6).alias("sim"))


def _signs(df: DataFrame) -> DataFrame:
    """64-bit hash: bit i is set where component i + 1 is positive."""
    return df.select("id", F.aggregate(F.transform("v", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)).alias("h"))


_HAMMING = "(SELECT sum(CASE WHEN (a.v[i] > 0) <> (b.v[i] > 0) THEN 1 ELSE 0 END) FROM range(1, 65) t(i))"


@register("hamming_pairs", f"WITH {_E} SELECT * FROM (SELECT a.id AS a, b.id AS b, {_HAMMING}::INT AS dist FROM E a JOIN E b ON a.id < b.id) WHERE dist <= 18")
def hamming_pairs(spark, sf_dir):
    side = _signs(rows(spark, sf_dir))
    return similarity.hamming_pairs(side, side, 18).where("a < b")


@register("candidate_pairs", f"""WITH {_E}, H AS (SELECT a.id AS a, b.id AS b, {_HAMMING}::INT AS dist, list_cosine_similarity(a.v, b.v) AS sim FROM E a JOIN E b ON a.id < b.id)
SELECT a, b, sim >= 0.4 AS flag_sim, dist <= 18 AS flag_hash FROM H WHERE sim >= 0.4 OR dist <= 18""")  # fmt: skip
def candidate_pairs(spark, sf_dir):
    side = rows(spark, sf_dir)
    near = similarity.pairs_over(side.select("id", "v"), side.select("id", "v"), 0.4).where("a < b").select("a", "b", F.lit(True).alias("flag_sim"))
    signs = _signs(side)
    hashed = similarity.hamming_pairs(signs, signs, 18).where("a < b").select("a", "b", F.lit(True).alias("flag_hash"))
    return near.join(hashed, ["a", "b"], "full").na.fill(False, ["flag_sim", "flag_hash"])


@register("pairs_per_row", f"WITH {_E}, N AS (SELECT a, count(*) AS n FROM P WHERE sim >= 0.4 GROUP BY a) SELECT id, coalesce(n, 0) AS n FROM E LEFT JOIN N ON id = a")
def pairs_per_row(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    counts = similarity.pairs_over(side, side, 0.4).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    return side.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@register("nearest_neighbour", f"WITH {_E} SELECT a, b, round(sim, 6) AS sim FROM P QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1")
def nearest_neighbour(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.top_k(side, side, 1).select("a", "b", F.round("sim", 6).alias("sim"))


def _top(k: int, where: str = "true") -> str:
    return f"T AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM P WHERE {where} QUALIFY rank <= {k})"


@register("recall_at_k", f"WITH {_E}, {_top(10)}, F AS (SELECT a, min(CASE WHEN fa = fb THEN rank END) AS f FROM T GROUP BY a) SELECT k::INT AS k, round(avg(CASE WHEN f <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM F, (VALUES (1), (2), (5), (10)) K(k) GROUP BY k")
def recall_at_k(spark, sf_dir):
    side = rows(spark, sf_dir)
    found = similarity.top_k(side.select("id", "v"), side.select("id", "v"), 10)
    return similarity.recall_at(found, side.select("id", F.col("fine").alias("y")), [1, 2, 5, 10]).select("k", F.round("recall", 6).alias("recall"))


@register("recall_within_coarse", f"WITH {_E}, {_top(1, 'ca = cb')} SELECT ca AS coarse, round(avg(CASE WHEN fa = fb THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM T GROUP BY ca")
def recall_within_coarse(spark, sf_dir):
    df = rows(spark, sf_dir)
    side = df.select("id", "v", F.col("coarse").alias("g"))
    found = similarity.top_k(side, side, 1)
    a, b = df.select(F.col("id").alias("a"), "coarse", F.col("fine").alias("fa")), df.select(F.col("id").alias("b"), F.col("fine").alias("fb"))
    return found.join(a, "a").join(b, "b").groupBy("coarse").agg(F.round(F.avg(F.when(F.col("fa") == F.col("fb"), 1.0).otherwise(0.0)), 6).alias("recall"), F.count("*").alias("n"))


@register("knn_vote", f"""WITH {_E}, {_top(20, _TRAIN.format('b') + ' AND NOT ' + _TRAIN.format('a'))}, V AS (SELECT a, fa, fb, count(*) AS n FROM T GROUP BY ALL)
SELECT a AS id, fb AS predicted, fa = fb AS correct FROM V QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, fb) = 1""")  # fmt: skip
def knn_vote(spark, sf_dir):
    df = rows(spark, sf_dir)
    train = F.expr("substr(md5(CAST(id AS STRING)), 1, 1) < '8'")
    found = similarity.top_k(df.where(~train).select("id", "v"), df.where(train).select("id", "v"), 20)
    voted = similarity.vote(found, df.select("id", F.col("fine").alias("y")))
    return voted.join(df.select(F.col("id").alias("a"), "fine"), "a").select(F.col("a").alias("id"), F.col("y").alias("predicted"), (F.col("y") == F.col("fine")).alias("correct"))


@register("rank_both_ways", f"""WITH {_E}, R AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM P WHERE ca = 0 AND cb = 0)
SELECT x.a, x.b, x.rank AS rank_ab, y.rank AS rank_ba FROM R x JOIN R y ON x.a = y.b AND x.b = y.a WHERE x.rank <= 5 AND (x.rank < y.rank OR x.rank = y.rank AND x.a < x.b)""")  # fmt: skip
def rank_both_ways(spark, sf_dir):
    side = rows(spark, sf_dir).where("coarse = 0").select("id", "v")
    return similarity.both_ways(side, 5)


@register("rank_both_ways_by_class", f"""WITH {_E}, C AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.coarse AS ca, list_cosine_similarity(a.v, b.v) AS sim FROM E a JOIN E b ON a.coarse = b.coarse AND a.id <> b.id),
R AS MATERIALIZED (SELECT ca, a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM C), F AS (SELECT * FROM R WHERE rank <= 5)
SELECT x.ca AS coarse, x.a, x.b, x.rank AS rank_ab, y.rank AS rank_ba FROM F x JOIN R y ON x.a = y.b AND x.b = y.a WHERE x.rank < y.rank OR x.rank = y.rank AND x.a < x.b""")  # fmt: skip
def rank_both_ways_by_class(spark, sf_dir):
    df = rows(spark, sf_dir)
    found = similarity.both_ways(df.select("id", "v", F.col("coarse").alias("g")), 5)
    return found.join(df.select(F.col("id").alias("a"), "coarse"), "a").select("coarse", "a", "b", "rank_ab", "rank_ba")


@register("knn_graph", f"WITH {_E}, {_top(5)}, B AS (SELECT a, b, sim FROM T UNION ALL SELECT b, a, sim FROM T) SELECT a, b, round(max(sim), 6) AS sim FROM B GROUP BY a, b")
def knn_graph(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v")
    return similarity.graph(similarity.top_k(side, side, 5)).select("a", "b", F.round("sim", 6).alias("sim"))


@register("memorization_share", f"""WITH {_E}, {_top(1, _TRAIN.format('b') + ' AND NOT ' + _TRAIN.format('a'))}
SELECT round(avg(sim), 6) AS mean_sim, round(avg(CASE WHEN sim > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM T""")  # fmt: skip
def memorization_share(spark, sf_dir):
    df = rows(spark, sf_dir).select("id", "v")
    train = F.expr("substr(md5(CAST(id AS STRING)), 1, 1) < '8'")
    found = similarity.top_k(df.where(~train), df.where(train), 1)
    return found.agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.avg(F.when(F.col("sim") > 0.5, 1.0).otherwise(0.0)), 6).alias("share"))


@register("geometry_d0_d1_d2", f"""WITH {_E} SELECT ca AS coarse, round(avg(CASE WHEN fa = fb THEN 2 - 2 * sim END), 6) AS d0, round(avg(CASE WHEN ca = cb AND fa <> fb THEN 2 - 2 * sim END), 6) AS d1,
  round(avg(CASE WHEN ca <> cb THEN 2 - 2 * sim END), 6) AS d2 FROM P GROUP BY ca""")  # fmt: skip
def geometry_d0_d1_d2(spark, sf_dir):
    return metrics.pair_distances(unit_rows(spark, sf_dir)).select("coarse", *[F.round(f"d{i}", 6).alias(f"d{i}") for i in range(3)])


@register("mean_pair_distance", f"WITH {_E} SELECT fa AS fine, round(avg(1 - sim), 6) AS div FROM P WHERE fa = fb GROUP BY fa")
def mean_pair_distance(spark, sf_dir):
    return metrics.mean_pair_distance(unit_rows(spark, sf_dir), "fine").where("n > 1").select("fine", F.round("div", 6).alias("div"))


@register("trace_covariance", f"WITH {_E}, D AS (SELECT fine, v[i] / sqrt(list_inner_product(v, v)) AS x, i FROM E, range(1, 65) t(i)), V AS (SELECT fine, i, var_samp(x) AS s FROM D GROUP BY ALL) SELECT fine, round(sum(s), 6) AS trace_cov FROM V GROUP BY fine")
def trace_covariance(spark, sf_dir):
    return metrics.trace_covariance(unit_rows(spark, sf_dir), "fine").select("fine", F.round("trace_cov", 6).alias("trace_cov"))


@register("medoids", f"""WITH {_E}, S AS (SELECT a, fa, round(sum(sim) + 1, 9) AS score FROM P WHERE fa = fb GROUP BY ALL)
SELECT fa AS fine, a AS id FROM S QUALIFY row_number() OVER (PARTITION BY fa ORDER BY score DESC, a) = 1""")  # fmt: skip
def medoids(spark, sf_dir):
    return metrics.medoid(unit_rows(spark, sf_dir), "fine")


@register("centroids", f"WITH {_E} SELECT fine, (i - 1)::INT AS i, round(avg(v[i]), 6) AS x FROM E, range(1, 65) t(i) GROUP BY fine, i")
def centroids(spark, sf_dir):
    return rows(spark, sf_dir).select("fine", F.posexplode("v").alias("i", "x")).groupBy("fine", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


_POLY = "pow(list_inner_product(x.v, y.v) / 64 + 1, 3)"


@register("kid_halves", f"""WITH {_E}, X AS (SELECT * FROM E WHERE {_TRAIN.format('id')}), Y AS (SELECT * FROM E WHERE NOT {_TRAIN.format('id')})
SELECT round((SELECT avg({_POLY}) FROM X x JOIN X y ON x.id <> y.id) + (SELECT avg({_POLY}) FROM Y x JOIN Y y ON x.id <> y.id) - 2 * (SELECT avg({_POLY}) FROM X x, Y y), 6) AS kid""")  # fmt: skip
def kid_halves(spark, sf_dir):
    from strata.operators.sets import kernel_distance

    train = F.expr("substr(md5(CAST(id AS STRING)), 1, 1) < '8'")
    df = rows(spark, sf_dir).select("id", "v")
    return kernel_distance(df.where(train), df.where(~train)).select(F.round("kid", 6).alias("kid"))




@register("participation_ratio", f"""WITH {_E}, N AS (SELECT fine, id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS u FROM E),
D AS (SELECT fine, id, i, u[i] AS x FROM N, range(1, 65) t(i)), C AS (SELECT fine, id, i, x - avg(x) OVER (PARTITION BY fine, i) AS x FROM D),
G AS (SELECT p.fine, p.i, q.i AS j, sum(p.x * q.x) AS g FROM C p JOIN C q ON p.fine = q.fine AND p.id = q.id GROUP BY ALL)
SELECT fine, round(pow(sum(CASE WHEN i = j THEN g END), 2) / nullif(sum(g * g), 0), 5) AS pr FROM G GROUP BY fine""".replace("[x / sqrt(list_inner_product(v, v)) FOR x IN v]", "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"))  # fmt: skip
def participation_ratio(spark, sf_dir):
    from strata.operators.sets import participation

    return participation(unit_rows(spark, sf_dir), "fine").select("fine", F.round("pr", 5).alias("pr"))


@register("pair_zscore", f"WITH {_E} SELECT a, b, round((sim - avg(sim) OVER ()) / nullif(stddev_pop(sim) OVER (), 0), 5) AS z FROM P WHERE ca = 0 AND cb = 0")
def pair_zscore(spark, sf_dir):
    side = rows(spark, sf_dir).where("coarse = 0").select("id", "v", F.col("coarse").cast("long").alias("g"))
    return similarity.pair_scores(side).select("a", "b", F.round("z", 5).alias("z"))


@register("pair_auroc", f"""WITH {_E}, R AS (SELECT fa = fb AS same, rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS r FROM (SELECT *, round(sim, 9) AS s9 FROM P WHERE a < b AND ca = 2 AND cb = 2) q(a, b, fa, fb, ca, cb, s0, sim))
SELECT round((sum(CASE WHEN same THEN r END) - count_if(same) * (count_if(same) + 1) / 2.0) / (count_if(same) * count_if(NOT same)), 6) AS auroc FROM R""")  # fmt: skip
def pair_auroc(spark, sf_dir):
    return similarity.pair_auroc(_classes(spark, sf_dir).where("g = 2"), "fine").select(F.round("auroc", 6).alias("auroc"))


def _classes(spark, sf_dir):
    return rows(spark, sf_dir).select("id", "v", F.col("coarse").cast("long").alias("g"), "fine")


@register("pair_zscore_by_class", f"WITH {_E} SELECT ca AS coarse, a, b, round((sim - avg(sim) OVER (PARTITION BY ca)) / nullif(stddev_pop(sim) OVER (PARTITION BY ca), 0), 5) AS z FROM P WHERE ca = cb")
def pair_zscore_by_class(spark, sf_dir):
    return similarity.pair_scores(_classes(spark, sf_dir).drop("fine")).select(F.col("g").cast("int").alias("coarse"), "a", "b", F.round("z", 5).alias("z"))


@register("pair_auroc_by_class", f"""WITH {_E}, R AS (SELECT ca, fa = fb AS same, rank() OVER (PARTITION BY ca ORDER BY s9) + (count(*) OVER (PARTITION BY ca, s9) - 1) / 2.0 AS r FROM (SELECT *, round(sim, 9) AS s9 FROM P WHERE a < b AND ca = cb))
SELECT ca AS coarse, round((sum(CASE WHEN same THEN r END) - count_if(same) * (count_if(same) + 1) / 2.0) / nullif(count_if(same) * count_if(NOT same), 0), 6) AS auroc FROM R GROUP BY ca""")  # fmt: skip
def pair_auroc_by_class(spark, sf_dir):
    return similarity.pair_auroc(_classes(spark, sf_dir), "fine").select(F.col("g").cast("int").alias("coarse"), F.round("auroc", 6).alias("auroc"))


@register("prototype_assignment", f"""WITH {_E}, C AS (SELECT fine, coarse, list(x ORDER BY i) AS c FROM (SELECT fine, coarse, i, avg(v[i]) AS x FROM E, range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL)
SELECT id, E.fine AS fine, C.fine AS assigned FROM E JOIN C ON E.coarse = C.coarse QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, C.fine) = 1""")  # fmt: skip
def prototype_assignment(spark, sf_dir):
    from strata.functions.vectors import cosine

    df = rows(spark, sf_dir)
    parts = df.select("fine", "coarse", F.posexplode("v").alias("i", "x")).groupBy("fine", "coarse", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(F.col("fine").alias("assigned"), "coarse").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    scored = df.join(means, "coarse").select("id", "fine", "assigned", F.round(cosine(F.col("v"), F.col("c")), 9).alias("sim"))
    return scored.groupBy("id", "fine").agg(F.max_by("assigned", F.struct("sim", -F.col("assigned"))).alias("assigned"))


_SIMHASH = """W AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents), T AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i : i + 1], ' '))) AS t FROM W WHERE len(w) > 0),
D AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(t), 9, 8))::BIGINT AS lo FROM T), C AS (SELECT doc_id, j, 2 * sum((lo >> j) & 1) > count(*) AS l, 2 * sum((hi >> j) & 1) > count(*) AS h FROM D, range(32) b(j) GROUP BY ALL),
H AS (SELECT doc_id AS id, sum(CASE WHEN l THEN 1::HUGEINT << j ELSE 0 END) AS lo, sum(CASE WHEN h THEN 1::HUGEINT << j ELSE 0 END) AS hi FROM (SELECT doc_id, j::INT AS j, l, h FROM C) GROUP BY doc_id)"""


@register("text_simhash", f"WITH {_SIMHASH} SELECT id, (CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END * 4294967296 + lo)::BIGINT AS h FROM H")
def text_simhash(spark, sf_dir):
    """A 64-bit fingerprint of each document's two-word shingles."""
    return similarity.simhash(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("simhash_pairs", f"""WITH {_SIMHASH}, R AS (SELECT hi, lo, min(id) AS id, count(*) AS n FROM H GROUP BY ALL), P AS (SELECT a.id AS a, b.id AS b, (bit_count(xor(a.hi::BIGINT, b.hi::BIGINT)) + bit_count(xor(a.lo::BIGINT, b.lo::BIGINT)))::INT AS dist FROM R a JOIN R b ON a.id < b.id)
SELECT * FROM P WHERE dist <= 4""")  # fmt: skip
def simhash_pairs(spark, sf_dir):
    """Fingerprints that differ in at most four bits, each by the smallest document that has it: copies are one fingerprint, so a group of them makes no pairs."""
    hashed = similarity.simhash(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    first = hashed.groupBy("h").agg(F.min("id").alias("id"))
    return similarity.hamming_pairs(first, first, 4).where("a < b")
