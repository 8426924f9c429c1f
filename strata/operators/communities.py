"""Communities of weighted graphs by the Leiden method, for all graphs at once.

Edges are (g, a, b, w), each in both directions; a graph g sees its own edges only. A level moves nodes between communities
until none gains, splits each community into well-connected parts, and makes these parts the nodes of the next level
(Traag et al. 2019). Levels start anew from the partition found until no node of the first level moves.

A round deals communities out to blocks, and a block moves nodes one after another, but only between communities that it
owns: nobody else changes these in that round, so each move's gain is exact and modularity never falls, however many
blocks work at once. A community joins the block of the community it is bound to most among those that a coin makes
leaders, and every round has another coin. A block takes at most ``BLOCK`` nodes; the others of a crowded one stay where
they are for that round. Rounds end when no node of the whole graph would gain. Only counts reach the driver.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import settled

#: Nodes that a block moves in a round, and the least gain, so that the order of sums decides nothing.
BLOCK, LEAST = 4096, 1e-9
_NODES = "g long, v long, c long"


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(g, q): the share of weight inside communities less ``resolution`` times what the degrees let expect, for labels (g, id, c)."""
    end = lambda x: labels.select("g", F.col("id").alias(x), F.col("c").alias(f"c_{x}"))
    per = edges.join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"]).groupBy("g", "c_a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("w")).otherwise(0.0)).alias("inside"))
    sums = per.groupBy("g").agg(F.sum("k").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return sums.select("g", (F.try_divide("inside", "m") - resolution * F.try_divide(F.col("kk"), F.col("m") * F.col("m"))).alias("q"))


def _start(edges: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(g, v, c, k, f): each node alone, its degree, and the resolution over the graph's summed degrees."""
    whole = edges.groupBy("g").agg(F.sum("w").alias("m")).join(resolutions, "g")
    nodes = edges.groupBy("g", F.col("a").alias("v")).agg(F.sum("w").alias("k")).join(whole, "g")
    return nodes.select("g", "v", F.col("v").alias("c"), "k", F.try_divide("resolution", "m").alias("f"))


def _ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``edges`` without loops, with these columns of both ends, as column_a and column_b."""
    end = lambda x: nodes.select("g", F.col("v").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return edges.where("a <> b").join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"])


def _gains(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether any node would gain by moving alone."""
    links = _ends(edges, nodes, "c").groupBy("g", F.col("a").alias("v"), F.col("c_b").alias("to")).agg(F.sum("w").alias("w"))
    totals = nodes.groupBy("g", F.col("c").alias("to")).agg(F.sum("k").alias("total"))
    own = F.col("to") == F.col("c")
    asked = links.join(nodes, ["g", "v"]).join(totals, ["g", "to"])
    gain = F.col("w") - F.col("f") * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0))
    best = asked.groupBy("g", "v", "c", "k", "f").agg(F.max(F.when(own, gain)).alias("stay"), F.max(F.when(~own, gain)).alias("best"))
    at_home = best.join(totals.withColumnRenamed("to", "c"), ["g", "c"])
    return not at_home.where(F.col("best") - F.coalesce("stay", -F.col("f") * F.col("k") * (F.col("total") - F.col("k"))) > LEAST).isEmpty()


def _dealt(edges: DataFrame, nodes: DataFrame, salt: int, block: int) -> tuple[DataFrame, bool]:
    """``nodes`` with ``at``, the block that owns the node's community, ``all_k``, the community's summed degrees, and whether the node moves; and whether every graph is one block."""
    totals = nodes.groupBy("g", "c").agg(F.sum("k").alias("all_k"), F.count("*").alias("members"))
    sizes = nodes.groupBy("g").agg(F.ceil(2 * F.count("*") / block).alias("blocks"))
    whole = (sizes.agg(F.max("blocks")).first()[0] or 0) <= 2
    if whole:
        owned = totals.withColumns({"at": F.lit(0).cast("long"), "share": F.lit(1).cast("long")})  # each graph is one block
    else:
        coin = lambda c: F.xxhash64("g", c, F.lit(salt)) % 2 == 0
        bonds = _ends(edges, nodes, "c").where("c_a <> c_b").where(coin("c_b")).groupBy("g", F.col("c_a").alias("c"), "c_b").agg(F.sum("w").alias("w"))
        leaders = bonds.groupBy("g", "c").agg(F.max_by("c_b", F.struct("w", "c_b")).alias("leader"))
        led = totals.join(leaders, ["g", "c"], "left").withColumn("leader", F.when(coin("c"), F.col("c")).otherwise(F.coalesce("leader", "c")))
        placed = led.join(sizes, "g").withColumn("at", F.pmod(F.xxhash64("g", "leader", F.lit(salt)), F.col("blocks")))
        crowds = placed.groupBy("g", "at").agg(F.ceil(F.sum("members") / block).alias("share"))
        owned = placed.join(crowds, ["g", "at"])
    dealt = nodes.join(owned.select("g", "c", "all_k", "at", "share"), ["g", "c"])
    return settled(dealt.withColumn("moves", F.pmod(F.xxhash64("v", F.lit(salt)), F.col("share")) == 0)), whole


def _in_blocks(edges: DataFrame, dealt: DataFrame, function) -> DataFrame:
    """``function(nodes, links)`` for each block: nodes that may move, and their links (v, u, c, w) to other such nodes u, or (u = null) to a community c that the block owns."""
    own = _ends(edges, dealt, "c", "at", "moves").where("at_a = at_b AND moves_a")
    links = own.groupBy(F.col("g").alias("of"), F.col("at_a").alias("in"), F.col("a").alias("v"), F.when(F.col("moves_b"), F.col("b")).alias("u"), F.col("c_b").alias("c")).agg(F.sum("w").alias("w"))
    return dealt.where("moves").groupBy("g", "at").cogroup(links.groupBy("of", "in")).applyInPandas(function, _NODES)


def _local(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Moves nodes between the block's communities until none gains."""
    nodes = nodes.sort_values("v")
    place = {v: i for i, v in enumerate(nodes["v"].to_numpy())}
    c, k, f = nodes["c"].to_numpy().copy(), nodes["k"].to_numpy(), nodes["f"].to_numpy()
    total = dict(zip(c, nodes["all_k"], strict=True))
    near: list[list] = [[] for _ in place]
    fixed: list[dict] = [{} for _ in place]
    for v, u, to, w in zip(links["v"], links["u"], links["c"], links["w"], strict=True):
        if u == u and u is not None:
            near[place[v]].append((place[int(u)], w))
        elif to in total:
            fixed[place[v]][to] = fixed[place[v]].get(to, 0.0) + w
    for seen in near:
        seen.sort()
    again = True
    while again:  # a pass over all nodes that moves none is the last
        again, waiting, queued = False, list(range(len(c))), [True] * len(c)
        for i in waiting:  # grows while it is read
            queued[i] = False
            weights = defaultdict(float, fixed[i])
            for j, w in near[i]:
                weights[c[j]] += w
            worth = {x: weights[x] - f[i] * k[i] * (total[x] - (k[i] if x == c[i] else 0.0)) for x in [*weights, c[i]]}
            best, to = max(((y, -x) for x, y in worth.items() if x != c[i]), default=(worth[c[i]], 0))
            if best > worth[c[i]] + LEAST:
                total[c[i]] -= k[i]
                total[-to] += k[i]
                c[i], again = -to, True
                for j, _ in near[i]:
                    if c[j] != c[i] and not queued[j]:
                        queued[j] = True
                        waiting.append(j)
    return pd.DataFrame({"g": nodes["g"], "v": nodes["v"], "c": c})


def _parted(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Splits each community: its nodes start alone, and well-connected ones that still are join the well-connected part that gains most."""
    nodes = nodes.sort_values("v")
    place = {v: i for i, v in enumerate(nodes["v"].to_numpy())}
    whole, k, f, all_k = (nodes[x].to_numpy() for x in ("c", "k", "f", "all_k"))
    near: list[list] = [[] for _ in place]
    bond = np.zeros(len(place))
    for v, u, to, w in zip(links["v"], links["u"], links["c"], links["w"], strict=True):
        i = place[v]
        if to == whole[i]:
            bond[i] += w
            if u == u and u is not None:
                near[i].append((place[int(u)], w))
    part, size, part_k = np.arange(len(place)), np.ones(len(place)), k.astype(float).copy()
    part_bond, fit = bond.copy(), lambda w, own, i: w >= f[i] * own * (all_k[i] - own) - LEAST
    for i in range(len(place)):
        if size[part[i]] > 1 or not fit(bond[i], k[i], i):
            continue
        weights: dict = defaultdict(float)
        for j, w in sorted(near[i]):
            if part[j] != part[i]:
                weights[part[j]] += w
        worth = [(weights[x] - f[i] * k[i] * part_k[x], -x) for x in weights if fit(part_bond[x], part_k[x], i)]
        best, to = max(worth, default=(0.0, 0))
        if best > LEAST:
            to, old = -to, part[i]
            part_bond[to] += bond[i] - 2 * weights[to]
            part_k[to] += k[i]
            size[to] += 1
            size[old], part_k[old], part_bond[old] = 0, 0.0, 0.0
            part[i] = to
    return pd.DataFrame({"g": nodes["g"], "v": nodes["v"], "c": nodes["v"].to_numpy()[part]})


def _moved(edges: DataFrame, nodes: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """The nodes when none gains by moving, and whether any moved."""
    salt, any_moved = 0, False
    while True:
        dealt, whole = _dealt(edges, nodes, salt, block)
        found = _in_blocks(edges, dealt, _local).withColumnRenamed("c", "to")
        after = settled(nodes.join(found, ["g", "v"], "left").withColumn("moved", F.coalesce(F.col("to") != F.col("c"), F.lit(False))).withColumn("c", F.coalesce("to", "c")).drop("to"))
        moved = not after.where("moved").isEmpty()
        nodes, any_moved, salt = after.drop("moved"), any_moved or moved, salt + 1
        if whole or not moved and not _gains(edges, nodes):
            return nodes, any_moved


def _refined(edges: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(g, v, c, part, k, f): each community's (``part``) well-connected parts; ``c`` is one of the part's nodes. A community of more nodes than a block holds is split by what it is dealt out to."""
    totals = nodes.groupBy("g", "c").agg(F.sum("k").alias("all_k"), F.ceil(F.count("*") / block).alias("share"))
    blocks = nodes.groupBy("g").agg(F.ceil(2 * F.count("*") / block).alias("blocks"))
    at = F.xxhash64("c", F.pmod(F.xxhash64("v"), F.col("share")))
    dealt = settled(nodes.join(totals, ["g", "c"]).join(blocks, "g").withColumn("at", F.when(F.col("share") > 1, at).otherwise(F.pmod(F.xxhash64("c"), F.col("blocks")))).withColumn("moves", F.lit(True)))
    found = _in_blocks(edges, dealt, _parted).withColumnRenamed("c", "up")
    return nodes.join(found, ["g", "v"]).select("g", "v", F.col("up").alias("c"), F.col("c").alias("part"), "k", "f")


def leiden(edges: DataFrame, resolutions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, id, c): the community of each node with an edge, named by its smallest node; ``resolutions`` is (g, resolution)."""
    edges = settled(edges.select(F.col("g").cast("long").alias("g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).where("w > 0"))
    base = settled(_start(edges, resolutions.select(F.col("g").cast("long").alias("g"), F.col("resolution").cast("double").alias("resolution"))))
    while True:
        base, any_moved = _moved(edges, base, block)
        if not any_moved:
            break
        at, links, members = base, edges, base.select("g", F.col("v").alias("id"), "v")
        while True:
            named = settled(_refined(links, at, block))
            members = settled(members.join(named.select("g", "v", F.col("c").alias("up")), ["g", "v"]).select("g", "id", F.col("up").alias("v")))
            before = named.count()
            end = lambda x, named=named: named.select("g", F.col("v").alias(x), F.col("c").alias(f"c_{x}"))
            links = settled(links.join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"]).groupBy("g", F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.sum("w").alias("w")))
            at = settled(named.groupBy("g", F.col("c").alias("v")).agg(F.max("part").alias("c"), F.sum("k").alias("k"), F.max("f").alias("f")))
            if at.count() == before:
                break
            at, _ = _moved(links, at, block)
        found = members.join(at.select("g", "v", "c"), ["g", "v"]).select("g", F.col("id").alias("v"), "c")
        base = settled(base.drop("c").join(found, ["g", "v"]))
    least = base.groupBy("g", "c").agg(F.min("v").alias("least"))
    return base.join(least, ["g", "c"]).select("g", F.col("v").alias("id"), F.col("least").alias("c"))


def leiden_to_k(edges: DataFrame, k_of: dict[int, int], halvings: int = 30, points: int = 3) -> DataFrame:
    """(g, id, c, resolution): the partition of each graph with k communities, or the nearest to that which was met.

    The logarithm of the resolution is searched in [-3, 3]. A step tries ``points`` places in between, for all graphs
    without an exact partition at once, and goes on between those that give too few and too many, until the range is
    halved ``halvings`` times.
    """
    spark = edges.sparkSession
    edges = settled(edges.where(F.col("g").isin(list(k_of))))
    span = {g: (-3.0, 3.0) for g in k_of}
    best: dict[int, tuple[int, int, DataFrame]] = {}
    for _ in range(math.ceil(halvings / math.log2(points + 1))):
        tried = {g: [low + (high - low) * (i + 1) / (points + 1) for i in range(points)] for g, (low, high) in span.items()}
        places = spark.createDataFrame([(g * points + i, g, 10**x) for g, own in tried.items() for i, x in enumerate(own)], "at long, of long, resolution double")
        named = F.broadcast(places)  # a row for each graph and point
        graphs = edges.join(named, F.col("g") == F.col("of")).select(F.col("at").alias("g"), "a", "b", "w")
        found = leiden(graphs, places.select(F.col("at").alias("g"), "resolution"))
        found = settled(found.join(named, F.col("g") == F.col("at")).select(F.col("of").alias("g"), "id", "c", "resolution", "at"))
        counts = {r["at"]: r["n"] for r in found.groupBy("at").agg(F.count_distinct("c").alias("n")).collect()}
        following = {}
        for g, places_of_g in tried.items():
            own = [(counts[g * points + i], i, x) for i, x in enumerate(places_of_g) if g * points + i in counts]  # none without edges
            nearest = min(((abs(n - k_of[g]), g * points + i) for n, i, _ in own), default=None)
            if nearest and (g not in best or nearest[0] < best[g][0]):
                best[g] = *nearest, found
            if nearest and best[g][0]:
                low = max([span[g][0], *[x for n, _, x in own if n < k_of[g]]])
                following[g] = low, min([span[g][1], *[x for n, _, x in own if n > k_of[g] and x > low]])
        span = following
        if not span:
            break
    kept = [found.where((F.col("g") == g) & (F.col("at") == at)).drop("at") for g, (_, at, found) in best.items()]
    return functools.reduce(DataFrame.unionByName, kept) if kept else edges.select("g", F.col("a").alias("id"), F.col("a").alias("c"), F.col("w").alias("resolution")).limit(0)
