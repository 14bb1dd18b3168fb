"""Merkle manifests: a hash per document, folded 16 at a time to a root per group and one over all groups, with proofs.

Only expressions: documents become leaves where they are read, leaves get their rank from written ranges, and rank digits
are grouped away one after the other. The rows of a block (16 ** DIGITS ranks of one tree) are brought together once; each
grouping nests the structs of the one before, so a block ends as one row that holds its nodes level by level. Block roots
are the leaves of the same procedure one stage up, until each tree has one root. On the way down a block meets the path of
its root by grouping the two rows of its key; exploding its nested nodes level by level then hands every leaf the digests
beside its own, without joins.

A proof is an array of (before, after), lowest level first: the digests of a node's run before and after it, concatenated
as lowercase hex. digest = sha256(before || digest || after), step by step, gives the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import numbered
from ..sources.scratch import discard
from .common import materialize

WIDTH = 16
#: Digits of a rank that one block holds: blocks of 256 nodes, some tens of kilobytes.
DIGITS = 2
BLOCK = WIDTH**DIGITS
STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value as `<bytes>:<value>`, null as `-`: no two rows of fields have the same text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """One hash of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree, ...) with rank, their place within their tree by order, and size, the rows of the tree.

    Places in the whole table come from ranges; a tree's rows lie next to each other, so its first place and its count,
    taken per range and tree, say the rest. The table of these has a row per tree and range, and no key of the join back
    holds more rows than a range does.
    """
    placed = materialize(numbered(rows, [F.col("tree"), *order], "__place").withColumn("__range", F.spark_partition_id()), "merkle-places")
    here = placed.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    tree = Window.partitionBy("tree")
    here = here.select("tree", "__range", F.sum("__n").over(tree).alias("size"), F.min("__first").over(tree).alias("__first"))
    return placed.join(here, ["tree", "__range"]).withColumn("rank", F.col("__place") - F.col("__first")).drop("__range", "__place", "__first")


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes (tree, rank, size, node: struct<digest, ...>) as one row per block: tree, rank (the block's number), size (the
    tree's blocks), height (levels that are hashed here) and node, its digest with the nested nodes below it.

    A tree of one node is not hashed again; one that fits a block is hashed until one node is left; blocks of a larger one
    are hashed DIGITS times, the last and shorter one too.
    """
    height = reduce(lambda c, k: c.when(F.col("size") <= WIDTH**k, k), range(1, DIGITS), F.when(F.col("size") <= 1, 0)).otherwise(DIGITS)
    digit = {f"digit{k}": F.floor(F.col("rank") / WIDTH**k) % WIDTH for k in range(DIGITS)}
    rows = nodes.select("tree", F.floor(F.col("rank") / BLOCK).alias("block"), "size", height.alias("height"), *(c.cast("int").alias(n) for n, c in digit.items()), "node")
    rows = rows.repartition("tree", "block")  # serves all groupings below
    for k in range(DIGITS):
        rest = [f"digit{j}" for j in range(DIGITS - 1, k, -1)]
        run = F.sort_array(F.collect_list(F.struct(f"digit{k}", "node")))
        rows = rows.groupBy("tree", "block", "size", "height", *rest).agg(F.transform(run, lambda x: x["node"]).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["digest"]), "")
        digest = F.when(F.col("height") > k, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["digest"])
        rows = rows.select("tree", "block", "size", "height", *rest, F.struct(digest.alias("digest"), "kids").alias("node"))
    return rows.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), "height", "node")


def handed_down(rows: DataFrame) -> DataFrame:
    """Block rows (tree, height, node, proof, top) as their nodes, each with its own proof: (tree, node, proof, top)."""
    for k in range(DIGITS - 1, -1, -1):
        rows = rows.select("tree", "height", "proof", "top", F.transform("node.kids", lambda x: x["digest"]).alias("digests"), F.posexplode("node.kids").alias("at", "node"))
        before = F.array_join(F.slice("digests", 1, F.col("at")), "")
        after = F.array_join(F.slice("digests", F.col("at") + 2, WIDTH), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        rows = rows.select("tree", "height", "node", F.when(F.col("height") > k, F.concat(step, "proof")).otherwise(F.col("proof")).alias("proof"), "top")
    return rows.drop("height")


def forest(nodes: DataFrame, crown) -> DataFrame:
    """All trees of nodes (tree, rank, size, node). crown takes (tree, digest) of the roots and returns (tree, proof, top):
    what is above each root. Returns (tree, node, proof, top) for every node."""
    whole = materialize(blocks(nodes), "merkle-blocks")
    digests = whole.select("tree", "rank", "size", F.struct("node.digest").alias("node"))
    if whole.where("size > 1").isEmpty():
        above = crown(digests.select("tree", "node.digest")).withColumn("rank", F.lit(0).cast("long"))
        above = above.select("tree", "rank", "proof", "top")
    else:  # a block's key is its place among the nodes of the next stage
        keyed = digests.select("tree", "rank", "size", F.struct("node.digest", F.col("rank").alias("below")).alias("node"))
        above = forest(keyed, crown).select("tree", F.col("node.below").alias("rank"), "proof", "top")
    mine = whole.select("tree", "rank", F.struct("height", "node").alias("block"), F.lit(None).cast(above.schema["proof"].dataType).alias("proof"), F.lit(None).cast(above.schema["top"].dataType).alias("top"))
    theirs = above.select("tree", "rank", F.lit(None).cast(mine.schema["block"].dataType).alias("block"), "proof", "top")
    # two rows a key; collect_list passes over nulls
    met = mine.unionByName(theirs).groupBy("tree", "rank").agg(*(F.collect_list(c)[0].alias(c) for c in ("block", "proof", "top")))
    return handed_down(met.select("tree", "block.height", "block.node", "proof", "top"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", group: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: doc_id, its columns of keep, leaf, subroot (its group's), root and proof (of leaf to root).

    fields are hashed as they come, in this order. Leaves of a group ascend by doc_id (null first), rows that repeat an id
    by their hash; rows that repeat everything are leaves of their own, next to each other. Groups ascend bytewise, null
    first, and the empty group differs from null. Empty and very long texts are hashed like any other; columns that are not
    named are ignored. A table without rows gives none. doc_id may be of any type that has an order.
    """
    keep = keep or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = F.struct(leaf_digest(*(F.col(c) for c in fields)).alias("digest"), F.col(doc_id).alias("doc_id"), *(c.alias(f"keep_{n}") for n, c in keep.items()))
    leaves = materialize(docs.select(tree.alias("tree"), own.alias("node")), "merkle-leaves")
    placed = materialize(ranked(leaves, [F.col("node.doc_id").asc_nulls_first(), F.col("node.digest"), *(F.col(f"node.keep_{n}") for n in keep)]), "merkle-ranks")
    discard(leaves)

    def crown(roots: DataFrame) -> DataFrame:
        """Roots of groups are the leaves of one more tree."""
        roots = roots.select(F.lit("").alias("tree"), F.struct("digest", F.col("tree").alias("group")).alias("node"))
        top = lambda r: r.select("tree", F.array().cast(STEP).alias("proof"), F.col("digest").alias("top"))
        met = forest(ranked(roots, [F.col("node.group")]), top)
        return met.select(F.col("node.group").alias("tree"), "proof", F.struct(F.col("node.digest").alias("subroot"), F.col("top").alias("root")).alias("top"))

    found = forest(placed, crown)
    return found.select("node.doc_id", *(F.col(f"node.keep_{n}").alias(n) for n in keep), F.col("node.digest").alias("leaf"), "top.subroot", "top.root", "proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against rows of which every fifth by crc32 of its id has its text lower-cased
    (A-Z): folded_root is what such a row (else the row itself) folds to with the original proof, verified whether that is
    the root. A null id has no crc32, a null text nothing to lower: both stay."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = F.when(hit, leaf_digest(*values, F.translate("text", UPPER, LOWER)))
    found = manifest(docs, keep={"changed": now})
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
