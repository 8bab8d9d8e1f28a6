"""A Merkle manifest of documents, and proofs of all rows by multiproofs of blocks of leaves.

Every row is a leaf. The leaves of a language, ordered by id, form a tree of ARITY children a node; the
subroots of the languages, ordered by name, form one more. Rows are ordered by one range sort, and the row
counts of its partitions turn into positions. Blocks of BLOCK neighbouring leaves are the leaf partitions:

* `build` folds each block in one task and the block roots again in blocks, so a step does LEVELS levels;
* each block computes the least set of node coordinates that its own leaves cannot derive (`missing`), these
  are fetched by one join with the node table, and the block derives the interiors its leaves share and
  expands each leaf's proof from them.

No task sees more than a block, whatever the size of a language.

Result for every row, also for repeated ones: a null field is written `-`; a null id comes first in its
language, equal ids are ordered by leaf, equal leaves are interchangeable; null is a language of its own and
the first. An empty table has an empty manifest. Columns other than the five fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk.llm.common import cut, small

ARITY = 8
#: Levels that one task folds; a block has ARITY ** LEVELS leaves.
LEVELS = 3
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots.
TOP = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree long, n long, level int, pos long, digest string"


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of a row: each field with its length in bytes before it, so no two rows share an encoding."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of the row with its text in lower case where 3 divides the id's checksum, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    values = {name: F.col(name) for name in FIELDS} | {"text": F.translate("text", _UPPER, _LOWER)}
    return F.when(chosen, leaf_of(values))


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while ARITY ** h < n:
        h += 1
    return h


def fold(digests: list[str]) -> list[str]:
    return [sha256("".join(digests[i: i + ARITY]).encode()).hexdigest() for i in range(0, len(digests), ARITY)]


def missing(positions: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The least set of coordinates (level, positions) that proofs of all these leaves need beside the leaves."""
    out, known, size, level = [], np.unique(positions), n, 0
    while size > 1:
        parents = np.unique(known // ARITY)
        run = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(run[run < size], known, assume_unique=True)))
        known, size, level = parents, -(-size // ARITY), level + 1
    return out


def _place(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree and pos, and one row per tree: tree, lang, n."""
    order = ("lang", "doc_id", "leaf", "at_")
    rows = leaves.withColumn("at_", F.monotonically_increasing_id())  # splits rows that are equal
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at_")
    rows = cut(rows.withColumn("seq", F.monotonically_increasing_id()))  # partition number and row number
    part = F.shiftright("seq", 33)
    runs = rows.groupBy("lang", part.alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    # One row for each language and partition, few even for very long tables.
    runs = cut(runs.withColumn("tree", F.dense_rank().over(Window.orderBy("lang")).cast("long") - 1))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy("tree")))
    starts = small(cut(runs.select(F.col("lang").alias("lang_"), F.col("part").alias("part_"), "tree", "n", (F.col("before") - F.col("first")).alias("shift"))))
    placed = rows.join(starts, rows["lang"].eqNullSafe(F.col("lang_")) & (part == F.col("part_")))
    placed = placed.select("tree", "n", (F.col("seq") + F.col("shift")).alias("pos"), "doc_id", "lang", "leaf", "shown")
    return placed, runs.groupBy("tree", "lang").agg(F.sum("rows").alias("n"))


def _fold_block(level: int, inner: bool):
    """Nodes above a block of nodes of one level, at most LEVELS levels up; without inner only the block's root."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        digests, at, n = block.column("digest").to_pylist(), block.column("pos")[0].as_py(), block.column("n")[0].as_py()
        rows, now = [], level
        while now < level + LEVELS and now < height(n):
            digests, at, now = fold(digests), at // ARITY, now + 1
            if inner or now == min(level + LEVELS, height(n)):
                rows += [(now, at + i, d) for i, d in enumerate(digests)]
        if now == 0:  # a tree of one leaf
            rows = [(0, 0, digests[0])]
        levels, pos, digests = zip(*rows, strict=True)
        tree = block.column("tree")[0].as_py()
        return pa.table({"tree": pa.array([tree] * len(rows), pa.int64()), "n": pa.array([n] * len(rows), pa.int64()),
                         "level": pa.array(levels, pa.int32()), "pos": pa.array(pos, pa.int64()), "digest": pa.array(digests)})

    return run


def build(leaves: DataFrame, longest: int, inner: bool) -> DataFrame:
    """Nodes above leaves (tree, n, pos, digest): all, or without inner only what a block of leaves cannot derive alone."""
    tables, now, level = [], leaves, 0
    while True:
        blocks = now.select("tree", "n", "pos", "digest").groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block"))
        tables.append(cut(blocks.applyInArrow(_fold_block(level, inner or level > 0), _NODE)))
        level += LEVELS
        if ARITY ** level >= longest:
            return reduce(DataFrame.union, tables)
        now = tables[-1].where((F.col("level") == level) & (F.col("n") > ARITY ** level))


def _wanted(n_trees: int):
    """Coordinates that each block (tree, n, block) misses: in its own tree and, above, in that of the subroots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "block")), strict=True):
                own = missing(np.arange(block * BLOCK, min(n, (block + 1) * BLOCK)), n)
                for of, found in ((tree, own), (TOP, missing(np.array([tree]), n_trees))):
                    for level, pos in found:
                        k = len(pos)
                        yield pa.record_batch({"of_tree": pa.array([tree] * k, pa.int64()), "of_block": pa.array([block] * k, pa.int64()),
                                               "tree": pa.array([of] * k, pa.int64()), "level": pa.array([level] * k, pa.int32()), "pos": pa.array(pos, pa.int64())})

    return run


def _expand(n_trees: int, kind: str):
    """Proofs of a block's leaves from its own leaves and the fetched nodes."""
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        tree, n = leaves.column("tree")[0].as_py(), leaves.column("n")[0].as_py()
        nodes = {(t, level, p): d for t, level, p, d in zip(*(fetched.column(c).to_pylist() for c in ("node_tree", "level", "pos", "digest")), strict=True)}
        positions = leaves.column("pos").to_pylist()
        nodes.update(((tree, 0, p), d) for p, d in zip(positions, leaves.column("leaf").to_pylist(), strict=True))
        runs: dict[tuple[int, int, int], list[str]] = {}

        def climb(t: int, known: list[int], size: int) -> str:
            level = 0
            while size > 1:
                parents = sorted({p // ARITY for p in known})
                for p in parents:
                    run = [nodes[t, level, c] for c in range(p * ARITY, min(size, (p + 1) * ARITY))]
                    runs[t, level, p] = run
                    nodes[t, level + 1, p] = fold(run)[0]
                known, size, level = parents, -(-size // ARITY), level + 1
            return nodes[t, level, 0]

        subroot = climb(tree, positions, n)
        nodes[TOP, 0, tree] = subroot
        root = climb(TOP, [tree], n_trees)

        def steps(t: int, p: int, levels: int, first: int = 0) -> list[dict[str, list[str]]]:
            out = []
            for level in range(first, levels):
                at = p // ARITY ** level
                run, k = runs[t, level, at // ARITY], at % ARITY
                out.append({"left": run[:k], "right": run[k + 1:]})
            return out

        up = height(n)
        near = min(LEVELS, up)
        shared = steps(tree, positions[0], up, near) + steps(TOP, tree, height(n_trees))  # equal for the whole block
        proofs = [steps(tree, p, near) + shared for p in positions]
        step = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
        k = len(positions)
        return pa.table({"doc_id": leaves.column("doc_id"), "lang": leaves.column("lang"), "pos": leaves.column("pos"), "leaf": leaves.column("leaf"),
                         "shown": leaves.column("shown"), "subroot": pa.array([subroot] * k), "root": pa.array([root] * k),
                         "proof": pa.array(proofs, pa.list_(step))})

    schema = (f"doc_id {kind}, lang string, pos long, leaf string, shown string, subroot string, root string, "
              "proof array<struct<left: array<string>, right: array<string>>>")
    return run, schema


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, pos in its tree, leaf, shown (the tampered leaf or null), subroot, root and proof.

    A proof has a step for every level: the digests left and right of the node in its run.
    """
    own = leaf_of({name: F.col(name) for name in FIELDS})
    leaves = cut(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), own.alias("leaf"), tampered(docs).alias("shown")))
    placed, trees = _place(leaves)
    placed, trees = cut(placed), cut(trees)
    run_size = trees.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    n_trees, longest = run_size["trees"], run_size["longest"]
    nodes = build(placed.withColumnRenamed("leaf", "digest"), longest, False)
    heights = F.lit(0).cast("int")  # height(n) as a column
    for k in range(height(longest)):
        heights = F.when(F.col("n") > ARITY ** k, k + 1).otherwise(heights)
    subroots = cut(nodes.where(F.col("level") == heights).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "digest"))
    table = nodes.union(build(subroots, n_trees, True)).union(subroots)

    is_block = F.col("level") == F.least(F.lit(LEVELS), heights)
    blocks = nodes.where(is_block).select("tree", "n", F.col("pos").alias("block"))
    wanted = blocks.mapInArrow(_wanted(n_trees), "of_tree long, of_block long, tree long, level int, pos long")
    table = small(cut(table.select("tree", "level", "pos", "digest").distinct()))  # a tree of one subroot has it twice
    fetched = wanted.join(table, ["tree", "level", "pos"]).select(
        F.col("of_tree").alias("tree"), F.col("of_block").alias("block"), F.col("tree").alias("node_tree"), "level", "pos", "digest")
    run, schema = _expand(n_trees, leaves.schema["doc_id"].dataType.simpleString())
    placed = placed.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return placed.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(run, schema)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), ""), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda now, s: F.sha2(F.concat(F.array_join(s["left"], ""), now, F.array_join(s["right"], "")), 256))


def verify(proved: DataFrame) -> DataFrame:
    """Digests of the manifest of untampered rows, and the root folded from the tampered ones."""
    folded = fold_proof(F.coalesce("shown", "leaf"), F.col("proof"))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
