"""Merkle manifest of a dataset: one tree a source, one tree over the sources, and a proof for every row.

A leaf hashes a row's fields with their lengths. Leaves of a source ascend by doc_id; while there is more than one node,
each run of ``FAN`` becomes the hash of its members. The sources' roots, in order of source, become the root likewise.

Method: supersteps over RDDs, as in Pregel. A vertex is a block of ``FAN ** DEPTH`` neighbouring nodes of one tree. Going
up, a block hashes its levels and sends the node that remains to the block above, which is complete when the superstep
ends; a tree is done when its block has a single node. Going down, a block sends each of its nodes the siblings from
there to the root, which that node's own block passes on to its members; at the leaves the paths verify what was tampered
with. A key holds one block, so a source with a third of all rows is as many keys as it needs. What a superstep made is
written to the shared folder, so a lost executor costs one superstep at most, and a level has one node in ``FAN ** DEPTH``
of the level below.

Null fields are written as ``-``. A null doc_id comes first in its source and counts as the empty text for tampering;
rows of one doc_id are in order of their leaves, and equal rows are leaves each. A null source is a source, the first.
Very long texts are hashed whole, before rows are moved. An empty table gives an empty result. Columns other than
doc_id, source, lang, n_chars and text take no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ordering

#: Nodes of a run, and levels that one superstep climbs.
FAN, DEPTH = 3, 4

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "tree string, block long, nodes array<string>"
_PATH = "tree string, block long, lefts array<string>, rights array<string>, roots array<string>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of each field's UTF-8 byte count, colon and value, or ``-`` where it is null."""
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[written(c.cast("string")) for c in fields]).cast("binary"), 256)


def _above(nodes: list[str]) -> list[str]:
    return [_hash("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]


def _levels(block: int, nodes: list[str]) -> list[list[str]]:
    """The block's levels from ``nodes`` up to the node it sends. Only a tree's first block can be its only one; where that is full, it ends in the same node either way."""
    out = [nodes]
    while len(out[-1]) > 1 or block and len(out) <= DEPTH:
        out.append(_above(out[-1]))
    return out


def _siblings(levels: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of node i in its run, level by level, each written in one text."""
    for nodes in levels[:-1]:
        start = i - i % FAN
        yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + FAN])
        i //= FAN


def _written(rdd: RDD, schema: str, df: DataFrame, tag: str) -> DataFrame:
    return common.materialize(df.sparkSession.createDataFrame(rdd, schema, verifySchema=False), tag)


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _vertices(df: DataFrame) -> RDD:
    """((tree, block), the other columns) of blocks or of paths."""
    return df.rdd.map(lambda r: ((r[0], r[1]), r[2:]))


def _climb(blocks: DataFrame) -> list[DataFrame]:
    """The blocks (tree, block, nodes) of each superstep, lowest first; in the last each tree has one node."""
    found = [blocks]
    while not found[-1].where((F.col("block") > 0) | (F.size("nodes") > 1)).isEmpty():
        sent = found[-1].rdd.map(lambda r: ((r[0], r[1] // FAN**DEPTH), (r[1], _levels(r[1], r[2])[-1][0])))
        received = sent.groupByKey(_partitions(blocks)).map(lambda kv: (*kv[0], [h for _, h in sorted(kv[1])]))
        found.append(_written(received, _BLOCK, blocks, "up"))
    return found


def _sent(block: int, nodes: list[str], path: tuple) -> Iterator[tuple]:
    """For each node of a block: its number, what stands left and right of it from there to the root, and the roots passed."""
    levels = _levels(block, nodes)
    lefts, rights, roots = path
    for i in range(len(nodes)):
        own = list(_siblings(levels, i))
        yield block * FAN**DEPTH + i, [x for x, _ in own] + list(lefts), [x for _, x in own] + list(rights), list(roots)


def _descend(found: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The path of each lowest block's own node, from those of the last superstep's blocks."""
    for blocks in reversed(found[1:]):
        met = _vertices(blocks).join(_vertices(paths), _partitions(blocks))
        paths = _written(met.flatMap(lambda m: ((m[0][0], *sent) for sent in _sent(m[0][1], m[1][0][0], m[1][1]))), _PATH, blocks, "down")
    return paths


def _blocks(rows: DataFrame, tree: str, node: str, more: dict[str, str]) -> DataFrame:
    """(tree, block, nodes, more..): rows with ``place`` in blocks, each column of ``more`` as an array beside the nodes."""
    block = F.floor(F.col("place") / FAN**DEPTH).cast("long")
    one = F.struct("place", F.col(node).alias("nodes"), *[F.col(v).alias(k) for k, v in more.items()])
    held = rows.groupBy(F.col(tree).alias("tree"), block.alias("block")).agg(F.array_sort(F.collect_list(one)).alias("held"))
    return held.select("tree", "block", *[F.col(f"held.{c}").alias(c) for c in ("nodes", *more)])


def _verified(met: tuple) -> Iterator[tuple]:
    (_, block), ((nodes, ids, changed), path) = met
    subroot, root = path[2]
    for (_, lefts, rights, _), leaf, doc_id, other in zip(_sent(block, nodes, path), nodes, ids, changed, strict=True):
        back = leaf if other is None else other
        for left, right in zip(lefts, rights, strict=True):
            back = _hash(left + back + right)
        proof = "".join(left + right for left, right in zip(lefts, rights, strict=True))
        yield doc_id, leaf, subroot, root, _hash(proof), back, back == root


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``folded_root`` follows from the row's proof and its leaf, where 2 divides crc32 of the doc_id after the line feeds of its text are deleted.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(common.crc_mod("doc_id", 2) == 0, leaf_hash([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # sorts a null first
    leaves = common.materialize(docs.select(tree.alias("tree"), "doc_id", leaf_hash(fields).alias("leaf"), changed.alias("changed")), "leaves")
    leaves = ordering.placed(leaves, "tree", ["doc_id", "leaf"], "placed")
    lowest = common.materialize(_blocks(leaves, "tree", "leaf", {"ids": "doc_id", "changed": "changed"}), "blocks")
    up = _climb(lowest.select("tree", "block", "nodes"))

    subroots = up[-1].select(F.col("nodes")[0].alias("subroot"), F.col("tree").alias("of"), F.lit("").alias("all"))
    tops = common.materialize(_blocks(ordering.placed(subroots, "all", ["of"], "subroots"), "all", "subroot", {"of": "of"}), "blocks")
    over = _climb(tops.select("tree", "block", "nodes"))
    none = F.array().cast("array<string>")
    above = _descend(over, over[-1].select("tree", "block", none.alias("lefts"), none.alias("rights"), F.col("nodes").alias("roots")))

    def spread(met: tuple) -> Iterator[tuple]:
        (_, block), ((nodes, of), path) = met
        for (_, lefts, rights, roots), tree, subroot in zip(_sent(block, nodes, path), of, nodes, strict=True):
            yield tree, 0, lefts, rights, [subroot, *roots]

    paths = _descend(up, _written(_vertices(tops).join(_vertices(above), _partitions(docs)).flatMap(spread), _PATH, docs, "sources"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.sparkSession.createDataFrame(_vertices(lowest).join(_vertices(paths), _partitions(docs)).flatMap(_verified), schema, verifySchema=False)
