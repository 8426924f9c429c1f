"""Diffusion maps of weighted graphs and clusters on them, for all graphs at once (Coifman and Lafon 2006).

Edges are (g, a, b, w), each in both directions, as for communities. The walk's matrix is made symmetric by the roots of
the degrees; its leading eigenvectors come from subspace iteration with a Chebyshev filter (Zhou and Saad 2007). The
filter works on each vector by itself, so vectors are dealt out ``COLUMNS`` at a time: a task holds the links of one graph
and a few vectors, and a whole polynomial is one stage. Vectors then meet in ranges of ``ROWS`` nodes for their products.
A graph of more than ``HELD`` links is held by no task: there a product is a join of the links with the vectors on one end
and a sum by the other, and a node is also linked to itself, so a step refers to the step before once. What meets on the
driver are the vectors' products with each other, ``width`` squared numbers a graph, summed up beforehand. Isolated nodes
are in no edge and have no coordinates.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusterings
from .clusterings import K_MAX, Fit
from .durable import forget, settled

#: Vectors kept beyond those asked for, products in a round, the residual that is enough, and the most rounds.
SPARE, DEGREE, RESIDUAL, ROUNDS = 10, 10, 1e-6, 60
#: Links of a graph that a task holds (some 80 bytes each, by size, while it sorts them), vectors that it works on, and nodes whose vectors meet.
HELD, COLUMNS, ROWS = 1 << 23, 6, 1 << 13
#: Where a task does the products: the most of them in a round, and how many times itself a vector may take up of those before it.
MOST_DEGREE, TAKEN_UP = 40, 1e4


class Spectrum(NamedTuple):
    """(g, v, s, y0 ..): orthonormal eigenvectors and the roots of the degrees; each graph's eigenvalues by falling value, and nodes."""

    vectors: DataFrame
    values: dict[int, np.ndarray]
    sizes: dict[int, int]


def _links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, a, b, w, own): the symmetric matrix's cells, and each node's link to itself (own = 1, w = 0); and (g, v, s), the roots of the degrees."""
    edges = settled(edges.select(F.col("g").cast("long").alias("g"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).where("w > 0"))
    roots = settled(edges.groupBy("g", F.col("a").alias("v")).agg(F.sqrt(F.sum("w")).alias("s")))
    end = lambda x: roots.select("g", F.col("v").alias(x), F.col("s").alias(f"s_{x}"))
    cells = edges.join(end("a"), ["g", "a"]).join(end("b"), ["g", "b"]).select("g", "a", "b", (F.col("w") / F.col("s_a") / F.col("s_b")).alias("w"), F.lit(0.0).alias("own"))
    own = roots.select("g", F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0.0).alias("w"), F.lit(1.0).alias("own"))
    return settled(cells.unionByName(own)), roots


def _names(kind: str, width: int) -> list[str]:
    return [f"{kind}{i}" for i in range(width)]


def _step(links: DataFrame, state: DataFrame, weight: str, kept: str, width: int, before: bool, factor: float = 1.0) -> DataFrame:
    """(g, v, y.., kept..): the links' weighted sums of y, times ``factor`` and less q where there is one ``before``, and the old y as ``kept``."""
    met = links.join(state.withColumnRenamed("v", "b"), ["g", "b"])
    ys, qs = _names("y", width), _names("q", width)
    moved = [F.expr(f"sum({weight} * {y} * {factor}D{f' - own * {q}' if before else ''}) AS {y}") for y, q in zip(ys, qs, strict=True)]
    old = [F.expr(f"sum(own * {y}) AS {o}") for y, o in zip(ys, _names(kept, width), strict=True)]
    return met.groupBy("g", F.col("a").alias("v")).agg(*moved, *old)


def _filtered(links: DataFrame, state: DataFrame, cuts: dict[int, float], width: int) -> DataFrame:
    """The Chebyshev polynomial of the matrix on y that stays small between -1 and each graph's cut and grows above it."""
    spans = [(g, (c - 1) / 2, max((c + 1) / 2, 0.05)) for g, c in cuts.items()]
    scales = links.sparkSession.createDataFrame(spans, "g long, middle double, half double")
    round_links = settled(links.join(scales, "g").select("g", "a", "b", "own", (2 * (F.col("w") - F.col("own") * F.col("middle")) / F.col("half")).alias("c")))
    for step in range(DEGREE):
        before = state
        state = settled(_step(round_links, before, "c", "q", width, step > 0, 1.0 if step else 0.5))  # a deep plan of so many columns takes longer to plan than to run
        if step:
            forget(before)
    forget(round_links)
    return state.select("g", "v", *_names("y", width))


def _products(state: DataFrame, width: int) -> dict[int, np.ndarray]:
    """(3, width, width) for each graph: y'y, y'z and z'z."""
    ys, zs = _names("y", width), _names("z", width)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for g, own in frame.groupby("g"):
                y, z = own[ys].to_numpy(np.float64), own[zs].to_numpy(np.float64)
                held[int(g)] = held.get(int(g), 0) + np.stack([y.T @ y, y.T @ z, z.T @ z])
        yield pd.DataFrame([(g, x.tobytes()) for g, x in held.items()], columns=["g", "sums"])

    return _added(state.select("g", *ys, *zs).mapInPandas(add, "g long, sums binary").withColumn("salt", F.spark_partition_id() % 32), width)


def _ritz(products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling Ritz values, the turn of y into their vectors, and the residuals; fewer than the width where y has a lower rank."""
    g, h, k = products
    scale = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
    own, turn = np.linalg.eigh(g * np.outer(scale, scale))
    turn = scale[:, None] * turn[:, own > 1e-12 * own[-1]] / np.sqrt(own[own > 1e-12 * own[-1]])
    inner = turn.T @ h @ turn
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    turn = turn @ vectors[:, ::-1]
    values = values[::-1]
    return values, turn, np.sqrt(np.maximum(np.einsum("ji,jk,ki->i", turn, k, turn) - values**2, 0))


def _turned(state: DataFrame, turns: dict[int, np.ndarray], width: int) -> DataFrame:
    ys = _names("y", width)
    shared = state.sparkSession.sparkContext.broadcast(turns)  # width squared numbers a graph

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, own in frame.groupby("g"):
                turn = shared.value[int(g)]
                y = np.zeros((len(own), width))
                y[:, : turn.shape[1]] = own[ys].to_numpy(np.float64) @ turn
                yield pd.concat([own[["g", "v"]].reset_index(drop=True), pd.DataFrame(y, columns=ys)], axis=1)

    return state.select("g", "v", *ys).mapInPandas(run, "g long, v long, " + ", ".join(f"{y} double" for y in ys))


def _degree(ritz: np.ndarray, residuals: np.ndarray, cut: float) -> int:
    """Products in the next round: what a residual leaves of a leading vector in the others must not outgrow them."""
    middle, half = (cut - 1) / 2, max((cut + 1) / 2, 0.05)
    grown = np.arccosh(np.maximum((ritz - middle) / half, 1 + 1e-9))
    return int(np.clip((np.log(TAKEN_UP / np.maximum(residuals, 1e-8)) / grown).min(), 2, MOST_DEGREE))


def _chebyshev(multiply: Callable[[np.ndarray], np.ndarray], y: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """The filter of ``_filtered`` on vectors that a task holds."""
    middle, half = (cut - 1) / 2, max((cut + 1) / 2, 0.05)
    before, y = y, (multiply(y) - middle * y) / half
    for _ in range(degree - 1):
        before, y = y, 2 * (multiply(y) - middle * y) / half - before
    return y


def _packed_links(links: DataFrame) -> DataFrame:
    """(g, a, b, w): links, some thousands a row, as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, own in frame.groupby("g"):
                yield pd.DataFrame({"g": [g], "a": [own["a"].to_numpy("<i8").tobytes()], "b": [own["b"].to_numpy("<i8").tobytes()], "w": [own["w"].to_numpy("<f8").tobytes()]})

    return settled(links.select("g", "a", "b", "w").mapInPandas(run, "g long, a binary, b binary, w binary"))


def _round(packed: DataFrame, state: DataFrame | None, wanted: dict[int, tuple[float, int]], width: int) -> DataFrame:
    """(g, chunk, v, y, z, sums): a round's filtered vectors y of each graph and z, their products with the matrix, by ranges of nodes, and y'y, y'z and z'z of a range.

    ``state`` is (g, part, chunk, y), the vectors before, and ``wanted`` has each graph's cut and degree; without them vectors are drawn.
    """
    parts = -(-width // COLUMNS)
    dealt = packed.withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(parts)])))
    if state is None:
        state = packed.sparkSession.createDataFrame([], "g long, part int, chunk int, y binary")

    def filtered(key: tuple, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        g, part = int(key[0]), int(key[1])
        columns = slice(part * COLUMNS, min(width, (part + 1) * COLUMNS))
        a, b, w = (np.concatenate([np.frombuffer(x, kind) for x in own[c]] or [np.zeros(0, kind)]) for c, kind in (("a", "<i8"), ("b", "<i8"), ("w", "<f8")))
        order = np.argsort(a, kind="stable")
        nodes, begins = np.unique(a[order], return_index=True)
        b, w = np.searchsorted(nodes, b[order]), w[order]
        del a, order

        def multiply(x: np.ndarray) -> np.ndarray:
            return np.stack([np.add.reduceat(w * column[b], begins) for column in x])

        if g in wanted:
            held = held.sort_values("chunk")
            y = np.concatenate([np.frombuffer(x).reshape(columns.stop - columns.start, -1) for x in held["y"]], axis=1)
            y = _chebyshev(multiply, y, *wanted[g])
        else:
            y = 2 * clusterings.uniforms(nodes, 0, width)[:, columns].T - 1
        z = multiply(y)
        at = range(0, len(nodes), ROWS)
        cut = lambda x: [x[..., low : low + ROWS].tobytes() for low in at]
        return pd.DataFrame({"g": g, "chunk": range(len(at)), "part": part, "v": cut(nodes), "y": cut(y), "z": cut(z)})

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        y, z = (np.concatenate([np.frombuffer(x).reshape(-1, len(v) // 8) for x, v in zip(frame[c], frame["v"], strict=True)]) for c in "yz")
        first = frame.iloc[0]
        return pd.DataFrame({"g": [first["g"]], "chunk": [first["chunk"]], "v": [first["v"]], "y": [y.tobytes()], "z": [z.tobytes()], "sums": [np.stack([y @ y.T, y @ z.T, z @ z.T]).tobytes()]})

    columns = "g long, chunk int, part int, v binary, y binary, z binary"
    found = dealt.groupBy("g", "part").cogroup(state.groupBy("g", "part")).applyInPandas(filtered, columns)
    return settled(found.groupBy("g", "chunk").applyInPandas(met, "g long, chunk int, v binary, y binary, z binary, sums binary"))


def _added(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """(3, width, width) for each graph: the sums of (g, sums), of which 32 a graph at most reach the driver."""

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "sums": [np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0).tobytes()]})

    added: dict[int, np.ndarray] = {}
    for g, s in parts.groupBy("g", "salt").applyInPandas(total, "g long, sums binary").toPandas().itertuples(index=False):
        added[int(g)] = added.get(int(g), 0) + np.frombuffer(s).reshape(3, width, width)
    return added


def _dealt_again(now: DataFrame, turns: dict[int, np.ndarray], width: int) -> DataFrame:
    """(g, part, chunk, y): the turned vectors, ``COLUMNS`` at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                turn = turns[r.g]
                y = np.zeros((width, len(r.v) // 8))
                y[: turn.shape[1]] = turn.T @ np.frombuffer(r.y).reshape(width, -1)
                pieces = [y[low : low + COLUMNS].tobytes() for low in range(0, width, COLUMNS)]
                yield pd.DataFrame({"g": r.g, "part": range(len(pieces)), "chunk": r.chunk, "y": pieces})

    return now.select("g", "chunk", "v", "y").mapInPandas(run, "g long, part int, chunk int, y binary")


def _spread(now: DataFrame, turns: dict[int, np.ndarray], width: int) -> DataFrame:
    """(g, v, y..): the turned vectors, one row a node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                turn = turns[r.g]
                y = np.zeros((len(r.v) // 8, width))
                y[:, : turn.shape[1]] = np.frombuffer(r.y).reshape(width, -1).T @ turn
                yield pd.concat([pd.DataFrame({"g": r.g, "v": np.frombuffer(r.v, "<i8")}), pd.DataFrame(y, columns=_names("y", width))], axis=1)

    return now.select("g", "v", "y").mapInPandas(run, "g long, v long, " + ", ".join(f"{y} double" for y in _names("y", width)))


def _ended(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], size: int, sizes: dict[int, int]) -> list[int]:
    """The graphs whose ``size`` vectors, or as many as there are nodes, are settled."""
    return [g for g, (_, _, r) in found.items() if len(r) >= sizes[g] or (len(r) >= size and (r[:size] <= RESIDUAL).all())]


def _by_columns(links: DataFrame, sizes: dict[int, int], size: int) -> tuple[list[DataFrame], dict[int, np.ndarray]]:
    """Vectors (g, v, y..) and eigenvalues of graphs whose links a task holds."""
    width = size + SPARE
    packed, state, wanted, values, ended, spent = _packed_links(links), None, {}, {}, [], None
    for _ in range(ROUNDS):
        now = _round(packed, state, wanted, width)
        if spent is not None:
            forget(spent)
        found = {g: _ritz(p) for g, p in _added(now.select("g", "sums", (F.col("chunk") % 32).alias("salt")), width).items()}
        turns = {g: turn for g, (_, turn, _) in found.items()}
        done = _ended(found, size, sizes)
        values |= {g: found[g][0][: min(size, sizes[g])] for g in done}
        spent = None if done else now  # the next round is the last to read it
        if done:  # a graph that has ended is filtered no more
            ended.append(_spread(now.where(F.col("g").isin(done)), turns, width))
        wanted = {g: (float(ritz[-1]), _degree(ritz[:-1], r[:-1], float(ritz[-1]))) for g, (ritz, _, r) in found.items() if g not in values}
        if not wanted:
            return ended, values
        packed = packed.where(F.col("g").isin(list(wanted)))
        state = _dealt_again(now.where(F.col("g").isin(list(wanted))), turns, width)
    raise RuntimeError(f"eigenvectors of a graph are not settled after {ROUNDS} rounds")


def _by_joins(links: DataFrame, roots: DataFrame, sizes: dict[int, int], size: int) -> tuple[list[DataFrame], dict[int, np.ndarray]]:
    """Vectors (g, v, y..) and eigenvalues of graphs of any size."""
    width = size + SPARE
    drawn = [(F.xxhash64("g", "v", F.lit(i)) / F.lit(float(2**63))).alias(y) for i, y in enumerate(_names("y", width))]
    state, cuts, values, ended, spent = roots.select("g", "v", *drawn), None, {}, [], None
    for _ in range(ROUNDS):
        if cuts is not None:
            state = _filtered(links, state, cuts, width)
            if spent is not None:
                forget(spent)
        moved = _step(links, state, "w", "q", width, False)
        renamed = moved.select("g", "v", *[F.col(f"q{i}").alias(f"y{i}") for i in range(width)], *[F.col(f"y{i}").alias(f"z{i}") for i in range(width)])
        now = settled(renamed)
        found = {g: _ritz(p) for g, p in _products(now, width).items()}
        state = _turned(now, {g: turn for g, (_, turn, _) in found.items()}, width)
        done = _ended(found, size, sizes)
        values |= {g: found[g][0][: min(size, sizes[g])] for g in done}
        spent = None if done else now  # the next round's first step is the last to read it
        if done:  # a graph that has ended is filtered no more
            ended.append(state.where(F.col("g").isin(done)))
            state = state.where(~F.col("g").isin(done))
        cuts = {g: float(ritz[-1]) for g, (ritz, _, _) in found.items() if g not in values}
        if not cuts:
            return ended or [state], values
    raise RuntimeError(f"eigenvectors of a graph are not settled after {ROUNDS} rounds")


def spectrum(edges: DataFrame, size: int) -> Spectrum:
    """The ``size`` greatest eigenvalues of each graph's walk, with their vectors; a graph of fewer nodes has that many.

    A round ends with residuals of the whole graph; an error is raised where they are not small after ``ROUNDS`` rounds.
    """
    links, roots = _links(edges)
    counted = links.groupBy("g").agg(F.sum("own").cast("long").alias("n"), F.count("*").alias("links")).collect()  # one row a graph
    sizes = {int(r["g"]): int(r["n"]) for r in counted}
    held = [int(r["g"]) for r in counted if r["links"] <= HELD]
    ended, values = _by_columns(links.where(F.col("g").isin(held)), sizes, size) if held else ([], {})
    if len(held) < len(sizes) or not sizes:
        more, others = _by_joins(links.where(~F.col("g").isin(held)), roots.where(~F.col("g").isin(held)), sizes, size)
        ended, values = ended + more, values | others
    every = functools.reduce(DataFrame.unionByName, ended)
    return Spectrum(every.select("g", "v", *_names("y", size)).join(roots, ["g", "v"]), values, sizes)


def eigengap(values: np.ndarray, nodes: int, k_max: int = K_MAX) -> int:
    """The K from 2 to min(k_max, nodes - 2) with the greatest fall after the K-th eigenvalue, ties to the smaller; 1 for fewer than four nodes."""
    most = min(k_max, nodes - 2)
    return 2 + int(np.argmax(values[1:most] - values[2 : most + 1])) if most >= 2 else 1


def coordinates(found: Spectrum, k_of: dict[int, int], t: int = 1) -> DataFrame:
    """(id, g, v): the walk's right eigenvectors 2 .. k of each graph, each times its eigenvalue to the power t."""
    factors = [(g, k, [float(x) ** t for x in found.values[g]]) for g, k in k_of.items() if g in found.values]
    per_graph = found.vectors.sparkSession.createDataFrame(factors, "g long, k int, f array<double>")
    width = len([c for c in found.vectors.columns if c.startswith("y")])
    scaled = F.array(*[F.col(f"y{i}") / F.col("s") * F.coalesce(F.get("f", F.lit(i)), F.lit(0.0)) for i in range(1, width)])
    return found.vectors.join(per_graph, "g").select(F.col("v").alias("id"), "g", F.slice(scaled, 1, F.col("k") - 1).alias("v"))


def clusters(edges: DataFrame, k_of: dict[int, int] | None = None, t: int = 1, seed: int = 0, starts: int = 10) -> DataFrame:
    """(id, g, k, c): k-means on the diffusion coordinates, with each graph's own K or, without ``k_of``, that of its greatest eigengap.

    A graph with K = 1 is one cluster, and graphs without a K are left out. A K above the graph's nodes is cut to them.
    """
    found = spectrum(edges, max([K_MAX + 1 if k_of is None else 2, *(k_of or {}).values()]))
    chosen = {g: eigengap(v, found.sizes[g]) if k_of is None else min(k_of.get(g, 0), found.sizes[g]) for g, v in found.values.items()}
    several = {g: k for g, k in chosen.items() if k > 1}
    spark = edges.sparkSession
    lone = found.vectors.join(spark.createDataFrame([(g,) for g, k in chosen.items() if k == 1], "g long"), "g").select(F.col("v").alias("id"), "g", F.lit(1).alias("k"), F.lit(0).alias("c"))
    if not several:
        return lone
    placed = settled(coordinates(found, several, t))
    fitted = clusterings.fit_many(placed, [Fit(g, k, seed) for g, k in several.items()], starts)
    labelled = clusterings.labels_of(placed, {f.g: [centres] for f, (centres, _) in fitted.items()})
    ks = spark.createDataFrame(list(several.items()), "g long, k int")
    return labelled.join(ks, "g").select("id", "g", "k", F.get("labels", F.lit(0)).alias("c")).unionByName(lone)
