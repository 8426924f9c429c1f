"""Registered queries that draw few-shot episodes and measure generated rows against their supports and targets.

Test rows (id modulo 3 is 1) are the pools; generated rows (id modulo 3 is 0) of a class stand for what an episode's generator made.
Near-duplicates are pairs of a class with a cosine of at least ``NEAR``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.vectors import unit
from strata.operators import episodes, metrics, similarity
from strata.operators.durable import settled

from .embedding_queries import _E, rows
from .registry import register
from .synthesis_queries import _KID, _Q, _coverage_sql, _kid_sql, evaluated

KS, MIN_TARGET, ATTEMPTS, NEAR = (1, 5), 8, 4, 0.3
_EP = f"""EP AS (SELECT 'single_k' || k || '_c' || lpad(fine::VARCHAR, 3, '0') AS episode, k, coarse, fine FROM (SELECT coarse, fine, count(*) AS n FROM T GROUP BY ALL), (VALUES (1), (5)) K(k) WHERE n - k >= {MIN_TARGET}),
NP AS (SELECT x.id AS a, y.id AS b FROM T x JOIN T y ON x.fine = y.fine AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= {NEAR}),
DR AS (SELECT episode, k, EP.coarse, t AS attempt, EP.fine, id, v, CASE WHEN row_number() OVER (PARTITION BY episode, t ORDER BY md5('19:' || episode || ':' || t || ':' || id), id) <= k THEN 's' ELSE 't' END AS role FROM EP JOIN T ON T.fine = EP.fine, range({ATTEMPTS}) r(t)),
NN AS (SELECT s.episode, s.attempt, count(*) AS n FROM DR s JOIN NP ON s.id = NP.a JOIN DR t ON t.episode = s.episode AND t.attempt = s.attempt AND t.id = NP.b WHERE s.role = 's' AND t.role = 't' GROUP BY ALL),
CH AS (SELECT episode, coalesce(min(CASE WHEN coalesce(n, 0) = 0 THEN attempt END), max(attempt)) AS attempt FROM (SELECT DISTINCT episode, attempt FROM DR) d LEFT JOIN NN USING (episode, attempt) GROUP BY episode),
DD AS (SELECT DR.*, coalesce(NN.n, 0) AS n_near FROM DR JOIN CH USING (episode, attempt) LEFT JOIN NN USING (episode, attempt))"""
_DRAWN = f"{_Q}, {_EP}"


def _test(spark, sf_dir):
    return rows(spark, sf_dir).where("id % 3 = 1")


def _near(spark, sf_dir):
    side = _test(spark, sf_dir).select("id", "v", F.col("fine").alias("g"))
    return similarity.pairs_over(side, side, NEAR).select("a", "b")


def _episodes(spark, sf_dir):
    pools = _test(spark, sf_dir).select("fine", "coarse", "id")
    fit = episodes.eligibility(pools, list(KS), MIN_TARGET).where("reason IS NULL")
    return fit.join(pools.select("fine", "coarse").distinct(), "fine").select(F.format_string("single_k%d_c%03d", "k", "fine").alias("episode"), "k", "coarse", "fine")


def _drawn(spark, sf_dir):
    return episodes.draw(_test(spark, sf_dir).select("fine", "id"), _episodes(spark, sf_dir).select("episode", "fine", "k"), 19, ATTEMPTS, _near(spark, sf_dir))


@register("episode_eligibility", f"""{_Q}, C AS (SELECT fine, count(*) AS n_pool FROM T GROUP BY fine) SELECT k::INT AS k, fine, n_pool, CASE WHEN n_pool < k THEN printf('support pool %d < k=%d', n_pool, k) WHEN n_pool - k < 40 THEN printf('target %d < %d', n_pool - k, 40) END AS reason
 FROM C, (VALUES (1), (10), (60)) K(k)""")  # fmt: skip
def episode_eligibility(spark, sf_dir):
    return episodes.eligibility(_test(spark, sf_dir).select("fine", "id"), [1, 10, 60], 40)


@register("episodes_with_redraws", f"{_DRAWN} SELECT episode, attempt::INT AS attempt, n_near, string_agg(id::VARCHAR, ' ' ORDER BY id) FILTER (role = 's') AS support, count(*) FILTER (role = 't') AS n_target FROM DD GROUP BY ALL")
def episodes_with_redraws(spark, sf_dir):
    support = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "s", F.col("id")))), lambda x: x.cast("string"))
    return _drawn(spark, sf_dir).groupBy("episode", "attempt", "n_near").agg(F.array_join(support, " ").alias("support"), F.count_if(F.col("role") == "t").alias("n_target"))


@register("episode_summary", f"""{_DRAWN}, S AS (SELECT episode, split_part(episode, '_c', 1) AS family, max(attempt) AS attempt, max(n_near) AS n_near, count(*) FILTER (role = 't') AS n FROM DD GROUP BY episode)
SELECT family, count(*) AS episodes, count_if(attempt > 0) AS redrawn, count_if(n_near > 0) AS with_dup, min(n) AS min_target, list(n ORDER BY n)[count(*) // 2 + 1] AS median_target FROM S GROUP BY family""")  # fmt: skip
def episode_summary(spark, sf_dir):
    return episodes.summary(_drawn(spark, sf_dir), F.split_part("episode", F.lit("_c"), F.lit(1)))


@register("flat_episodes", f"""{_Q}, M AS (SELECT coarse, fine, id FROM T QUALIFY row_number() OVER (PARTITION BY fine ORDER BY id) <= 3) SELECT coarse, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM M GROUP BY coarse""")
def flat_episodes(spark, sf_dir):
    test = _test(spark, sf_dir).groupBy("coarse", "fine").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 3).alias("ids"))
    nested = test.groupBy("coarse").agg(F.map_from_entries(F.collect_list(F.struct(F.col("fine").cast("string"), "ids"))).alias("by_class"))
    return nested.select("coarse", F.array_join(F.transform(episodes.flat(F.col("by_class")), lambda x: x.cast("string")), " ").alias("ids"))


@register("near_pairs_known", f"WITH {_E} SELECT a, b FROM P WHERE a < b AND fa = fb AND sim >= {NEAR}")
def near_pairs_known(spark, sf_dir):
    side = rows(spark, sf_dir).select("id", "v", F.col("fine").alias("g"))
    return similarity.pairs_over(side, side, NEAR).where("a < b").select("a", "b")


@register("near_pairs_between", f"WITH {_E} SELECT count(*) AS n FROM P WHERE a % 2 = 0 AND b % 2 = 1 AND fa = fb AND sim >= {NEAR}")
def near_pairs_between(spark, sf_dir):
    ids = rows(spark, sf_dir).select("id")
    return similarity.links_between(near_pairs_known(spark, sf_dir), ids.where("id % 2 = 0"), ids.where("id % 2 = 1"))


@register("near_pair_index", f"WITH {_E} SELECT a AS id, string_agg(b::VARCHAR, ' ' ORDER BY b) AS others FROM P WHERE fa = fb AND sim >= {NEAR} GROUP BY a")
def near_pair_index(spark, sf_dir):
    return similarity.adjacency(near_pairs_known(spark, sf_dir)).select("id", F.array_join(F.transform("others", lambda x: x.cast("string")), " ").alias("others"))


def _made(spark, sf_dir):
    """Generated rows of each episode's class, with predictions."""
    return evaluated(spark, sf_dir).where("id % 3 = 0").join(_episodes(spark, sf_dir).select("episode", "k", "fine"), "fine")


@register("episode_hit_rate", f"{_DRAWN} SELECT episode, round(avg(CASE WHEN pred = EP.fine THEN 1.0 ELSE 0.0 END), 6) AS hit FROM EP JOIN G ON G.fine = EP.fine GROUP BY episode")
def episode_hit_rate(spark, sf_dir):
    return episodes.hit_rate(_made(spark, sf_dir)).select("episode", F.round("hit", 6).alias("hit"))


@register("episode_mixture_error", f"""{_Q}, X AS (SELECT a.coarse, a.fine AS a, b.fine AS b, r FROM D a JOIN D b ON a.coarse = b.coarse AND a.fine < b.fine, (VALUES (0.5), (0.7)) R(r))
SELECT X.coarse || '_' || a || '-' || b || '_r' || (r * 100)::INT AS episode, round(abs(avg(CASE WHEN e[a + 1] > e[b + 1] THEN 1.0 ELSE 0.0 END) - max(r)::DOUBLE), 6) AS error FROM X JOIN G ON G.fine = a OR G.fine = b GROUP BY ALL""")  # fmt: skip
def episode_mixture_error(spark, sf_dir):
    kinds = rows(spark, sf_dir).select("coarse", "fine").distinct()
    pairs = kinds.withColumnRenamed("fine", "a").join(kinds.withColumnRenamed("fine", "b"), "coarse").where("a < b").withColumn("ratio", F.explode(F.array(F.lit(0.5), F.lit(0.7))))
    name = F.concat(F.col("coarse"), F.lit("_"), "a", F.lit("-"), "b", F.lit("_r"), (F.col("ratio") * 100).cast("int"))
    asked = pairs.select(name.alias("episode"), "a", "b", "ratio", F.explode(F.array("a", "b")).alias("fine"))
    made = evaluated(spark, sf_dir).where("id % 3 = 0").select("fine", "probs").join(F.broadcast(asked), "fine")
    found = made.select("episode", "ratio", F.get("probs", F.col("a")).alias("p_a"), F.get("probs", F.col("b")).alias("p_b"))
    return episodes.mixture_error(found).select("episode", F.round("error", 6).alias("error"))


def _sides(spark, sf_dir):
    """(made, support, target) of all episodes as (id, v, g) with g a number of the episode."""
    number = lambda df: df.withColumn("g", F.col("k") * 1000 + F.col("fine"))
    vectors = rows(spark, sf_dir).select("id", "v")
    drawn = number(settled(_drawn(spark, sf_dir)).join(_episodes(spark, sf_dir).select("episode", "k"), "episode")).select("id", "g", "role").join(vectors, "id")
    made, drawn = settled(number(_made(spark, sf_dir)).select("id", "v", "g")), settled(drawn)
    return made, drawn.where("role = 's'").select("id", "v", "g"), drawn.where("role = 't'").select("id", "v", "g")


_SIDES = f"""{_DRAWN}, MG AS (SELECT G.id, G.v, EP.k * 1000 + EP.fine AS g FROM EP JOIN G ON G.fine = EP.fine), SG AS (SELECT id, v, k * 1000 + fine AS g FROM DD WHERE role = 's'), TG AS (SELECT id, v, k * 1000 + fine AS g FROM DD WHERE role = 't')"""


def _nearest_sql(a: str, b: str) -> str:
    return f"(SELECT g, avg(m) AS m FROM (SELECT x.g, x.id, max(list_cosine_similarity(x.v, y.v)) AS m FROM {a} x JOIN {b} y ON x.g = y.g GROUP BY ALL) GROUP BY g)"


@register("episode_exemplars", f"{_SIDES} SELECT s.g, round(s.m, 6) AS sim_s, round(t.m, 6) AS sim_t, round(r.m, 6) AS sim_t_to_s, round(s.m / r.m, 5) AS ratio_s FROM {_nearest_sql('MG', 'SG')} s JOIN {_nearest_sql('MG', 'TG')} t ON s.g = t.g JOIN {_nearest_sql('TG', 'SG')} r ON r.g = s.g")
def episode_exemplars(spark, sf_dir):
    return episodes.nearest_means(*_sides(spark, sf_dir)).select("g", *[F.round(c, 6).alias(c) for c in ("sim_s", "sim_t", "sim_t_to_s")], F.round("ratio_s", 5).alias("ratio_s"))


@register("episode_beyond_support", f"""{_SIDES} SELECT g.g, round(a.kid, 5) + 0.0 AS kid_t, round(b.coverage, 5) AS coverage_t, round(c.kid, 5) + 0.0 AS kid_s, round(d.coverage, 5) AS coverage_s FROM (SELECT DISTINCT g FROM MG) g LEFT JOIN {_kid_sql('MG', 'TG')} a ON a.g = g.g
 LEFT JOIN {_coverage_sql('TG', 'MG', 3)} b ON b.g = g.g LEFT JOIN {_kid_sql('MG', 'SG')} c ON c.g = g.g LEFT JOIN {_coverage_sql('SG', 'MG', 3)} d ON d.g = g.g""")  # fmt: skip
def episode_beyond_support(spark, sf_dir):
    return episodes.beyond_support(*_sides(spark, sf_dir)).select("g", *[(F.round(c, 5) + 0.0).alias(c) for c in ("kid_t", "coverage_t", "kid_s", "coverage_s")])


def _diversity(spark, sf_dir):
    made, _, target = _sides(spark, sf_dir)
    spread = lambda df, name: metrics.mean_pair_distance(df.select("id", "g", unit(F.col("v")).alias("u")).where("u IS NOT NULL"), "g").select("g", F.col("div").alias(name))
    return spread(made, "div_gen").join(spread(target, "div_t"), "g").withColumn("div_ratio", F.try_divide("div_gen", "div_t"))


_DIV = "(SELECT x.g, avg(1 - list_cosine_similarity(x.v, y.v)) AS d FROM {0} x JOIN {0} y ON x.g = y.g AND x.id <> y.id GROUP BY x.g)"


@register("episode_diversity", f"{_SIDES} SELECT a.g, round(a.d, 6) AS div_gen, round(b.d, 6) AS div_t, round(a.d / b.d, 5) AS div_ratio FROM {_DIV.format('MG')} a JOIN {_DIV.format('TG')} b ON a.g = b.g")
def episode_diversity(spark, sf_dir):
    return _diversity(spark, sf_dir).select("g", *[F.round(c, 6).alias(c) for c in ("div_gen", "div_t")], F.round("div_ratio", 5).alias("div_ratio"))


@register("episode_table", f"""{_SIDES}, H AS (SELECT EP.k, EP.coarse, EP.fine, avg(CASE WHEN pred = EP.fine THEN 1.0 ELSE 0.0 END) AS hit FROM EP JOIN G ON G.fine = EP.fine GROUP BY ALL),
R AS (SELECT 'single_k' || k AS family, coarse::VARCHAR AS "group", hit, a.d / b.d AS div_ratio FROM H JOIN {_DIV.format('MG')} a ON a.g = k * 1000 + fine JOIN {_DIV.format('TG')} b ON a.g = b.g),
C AS (SELECT family, "group", count(*) AS n, avg(hit) AS hit, avg(div_ratio) AS div_ratio FROM R GROUP BY ALL), U AS (SELECT * FROM C UNION ALL SELECT family, 'macro', count(*), avg(hit), avg(div_ratio) FROM C GROUP BY family)
SELECT family, "group", n, round(hit, 6) AS hit, round(div_ratio, 5) AS div_ratio FROM U""")  # fmt: skip
def episode_table(spark, sf_dir):
    own = _episodes(spark, sf_dir).withColumn("g", F.col("k") * 1000 + F.col("fine"))
    table = own.join(episodes.hit_rate(_made(spark, sf_dir)), "episode").join(_diversity(spark, sf_dir), "g").withColumn("family", F.format_string("single_k%d", "k"))
    return episodes.by_set(table, "family", "coarse", ["hit", "div_ratio"]).select("family", "group", "n", F.round("hit", 6).alias("hit"), F.round("div_ratio", 5).alias("div_ratio"))


@register("control_support_cycle", f"{_SIDES}, S AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM SG) SELECT g, i::INT AS i, id FROM S, range(8) r(i) WHERE i % n = pos")
def control_support_cycle(spark, sf_dir):
    """Copies of the support, cycled to eight rows an episode."""
    _, support, _ = _sides(spark, sf_dir)
    held = support.groupBy("g").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k ids an episode
    return held.select("g", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "ids").select("g", "i", F.get("ids", (F.col("i") % F.size("ids")).cast("int")).alias("id"))


@register("control_collapse", f"{_Q}, S AS (SELECT x.fine, x.id, round(sum(list_cosine_similarity(x.v, y.v)), 9) AS s FROM N x JOIN N y ON x.fine = y.fine GROUP BY ALL), M AS (SELECT fine, id FROM S QUALIFY row_number() OVER (PARTITION BY fine ORDER BY s DESC, id) = 1) SELECT fine, i::INT AS i, id FROM M, range(4) r(i)")
def control_collapse(spark, sf_dir):
    """The train medoid of each class, repeated four times."""
    df = rows(spark, sf_dir).where("id % 3 = 2").select("id", "fine", unit(F.col("v")).alias("u")).where("u IS NOT NULL")
    return metrics.medoid(df, "fine").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("fine", "i", "id")
