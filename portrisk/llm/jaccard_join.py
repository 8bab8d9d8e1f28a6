"""N-gram Jaccard join by chosen paths: which documents share most of their five-word shingles.

1. Rows with equal shingle sets (a 128-bit sum over the distinct shingles) are copies; from here on a node is
   a distinct set. A node carries HASHES minimum hashes of its set.
2. RUNS times, nodes are split recursively: a bucket picks BRANCHES of the minimum hashes, the same ones for all
   its nodes, and every node goes to one smaller bucket for each, by the value there. Buckets of one node end.
   Buckets of at most SMALL nodes are compared pair by pair on the minimum hashes; of pairs that may reach the
   limit, only a spanning forest is kept. Larger buckets split again. After DEPTH levels a bucket holds nearly
   equal sets only, so all its nodes are tied to its least one.
   A pair at similarity s survives a level with 1 - q, q = ((1 - s) + s q')^BRANCHES; at 0.8 a run finds 94 % and all
   RUNS over 99.9 %.
3. These ties give loose components. Inside each, all pairs are compared exactly, in tiles of bounded size:
   a component of any size is spread over tasks, and a tile returns link counts and a spanning forest of the
   true links, never its pairs.
4. Components of the true links are the classes.

So a link is missed only if no chain of ties joins its two documents. Copies are not expanded: n_links counts
the different texts linked, n_copies the rows with the same set.

Edge cases: texts with fewer than five words have one shingle; texts without a word (null too) form one set
without links; null ids are kept (a class takes its least id that is not null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import cut, small, sorted_groups
from portrisk.llm.components import components
from portrisk.llm.words import column_words, mix, shingles, slices

WORDS = 5
SIMILAR = 0.8
HASHES = 64
RUNS = 4
BRANCHES = 2
DEPTH = 4
SMALL = 64
#: Matching minimum hashes below which a pair at SIMILAR is seen with a chance under 1 in 10,000.
MAY_MATCH = 38
TILE_NODES = 256
TILE_BYTES = 8_000_000
#: Bytes of text that a task works on at once.
SLICE = 1 << 20

_RNG = np.random.default_rng(8)
_FLIPS = _RNG.integers(0, 1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def set_key(shingle_set: np.ndarray) -> bytes:
    """128 bits of a set of distinct shingles."""
    a = int(mix(shingle_set).sum(dtype=np.uint64))
    b = int(mix(shingle_set ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def min_hashes(shingle_set: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    high = (shingle_set >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(high), 1024):
        np.minimum(out, ((high[None, a: a + 1024] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    words, edge = column_words(column)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield np.unique(shingles(words[a:b], k))


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text", SLICE)):
            nodes, sketches, sizes = [], [], []
            for s in _sets(batch.column("_text"), k):
                nodes.append(set_key(s))
                sketches.append(min_hashes(s).tobytes())
                sizes.append(len(s))
            yield pa.record_batch([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
                                  names=["doc_id", "node", "n", "sketch"])

    source = docs.select("doc_id", F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, node binary, n int, sketch binary")


def _split(rows: DataFrame) -> DataFrame:
    """bucket, node for every smaller bucket of rows (bucket, node, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bucket = batch.column("bucket").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            for branch in range(BRANCHES):
                chosen = mix(bucket ^ mix(np.full(1, branch + 1, np.uint64)))
                place = (chosen % np.uint64(HASHES)).astype(np.int64)
                smaller = mix(chosen ^ sketch[np.arange(len(sketch)), place].astype(np.uint64))
                yield pa.record_batch([pa.array(smaller.view(np.int64)), batch.column("node")], names=["bucket", "node"])

    return rows.select("bucket", "node", "sketch").mapInArrow(run, "bucket long, node binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a-b among n nodes, those of a spanning forest."""
    parent, out = list(range(n)), []
    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[q] = p
            out.append((x, y))
    return out


def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for group in sorted_groups(batches, ("bucket",)):
        nodes = group.column("node").to_pylist()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        x, y = np.triu_indices(len(nodes), 1)
        close = (sketch[x] == sketch[y]).sum(axis=1) >= MAY_MATCH
        for p, q in _forest(len(nodes), x[close], y[close]):
            a.append(nodes[p])
            b.append(nodes[q])
        if len(a) > 10_000:
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _ties(nodes: DataFrame, runs: int) -> DataFrame:
    """Pairs of nodes that hold the loose components together."""
    start = nodes.select(F.explode(F.array(*[F.lit(r) for r in range(runs)])).alias("run"), "node", "sketch")
    now = cut(_split(start.select(F.xxhash64("run").alias("bucket"), "node", "sketch")))
    found = []
    for level in range(1, DEPTH + 1):
        # Counts alone are summed in hash maps; a least node makes Spark sort all rows, twice.
        sizes = [F.count(F.lit(1)).alias("size"), *([F.min("node").alias("least")] if level == DEPTH else [])]
        sized = now.join(now.groupBy("bucket").agg(*sizes).where("size > 1"), "bucket")
        if level == DEPTH:
            found.append(sized.where(F.col("size") > SMALL).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
        met = cut(sized.join(nodes.select("node", "sketch"), "node"))
        few = met.where(F.col("size") <= SMALL).select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
        found.append(few.mapInArrow(_bucket_ties, "a binary, b binary"))
        large = met.where(F.col("size") > SMALL)
        if level == DEPTH or large.isEmpty():
            break
        now = cut(_split(large))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _tiles(members: DataFrame, similar: float) -> DataFrame:
    """Per tile, a row for each node with links (n) and for each link of the spanning forest (to).

    members: node, root, n (shingles), set (bytes).
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.octet_length("set")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("nodes") / TILE_NODES), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    placed = members.join(sizes.select("root", parts.alias("parts")), "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A tile is a pair of parts; a node goes to all tiles of its part.
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "node", "set",
        (F.col("part") < F.col("other")).alias("left"), (F.col("part") == F.col("other")).alias("inner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("tile",)):
            nodes = group.column("node").to_pylist()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("set").to_pylist()]
            size = np.array([len(s) for s in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            edge = np.concatenate([[0], np.cumsum(size)])
            left, inner = group.column("left").to_numpy(), bool(group.column("inner")[0].as_py())
            here = np.zeros(int(code.max()) + 1 if len(code) else 1, dtype=bool)
            links, a, b = np.zeros(len(nodes), dtype=np.int64), [], []
            for i in range(len(nodes)):
                others = np.arange(i + 1, len(nodes)) if inner else np.flatnonzero(~left) if left[i] else np.zeros(0, np.int64)
                others = others[(size[others] >= similar * size[i]) & (size[i] >= similar * size[others])]
                if not len(others):
                    continue
                here[code[edge[i]: edge[i + 1]]] = True
                marked = np.concatenate([[0], np.cumsum(here[code])])
                here[code[edge[i]: edge[i + 1]]] = False
                both = marked[edge[others + 1]] - marked[edge[others]]
                right = others[both >= similar * (size[i] + size[others] - both) - 1e-9]
                links[i] += len(right)
                links[right] += 1
                a += [i] * len(right)
                b += right.tolist()
                if len(a) > 1_000_000:
                    kept = _forest(len(nodes), np.array(a), np.array(b))
                    a, b = [x for x, _ in kept], [y for _, y in kept]
            some = np.flatnonzero(links).tolist()
            forest = _forest(len(nodes), np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
            yield pa.record_batch([
                pa.array([nodes[i] for i in some] + [nodes[x] for x, _ in forest], pa.binary()),
                pa.array([None] * len(some) + [nodes[y] for _, y in forest], pa.binary()),
                pa.array(links[some].tolist() + [0] * len(forest), pa.int64())], names=["node", "to", "n"])

    return tiled.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(run, "node binary, to binary, n long")


def near_duplicates(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR, runs: int = RUNS) -> DataFrame:
    """doc_id, class_id (least id of the class), n_links, n_copies, kept (one row of each class) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(_sketch(docs, k).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]  # of repeated rows one leads
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), first.alias("first_row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    loose = components(_ties(nodes.where("n > 0"), runs))
    loose = cut(loose.union(loose.select(F.col("root").alias("node"), "root").distinct()))
    wanted = cut(nodes.join(loose, "node").select("node", "root", F.col("first_id").alias("want_id")))

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text", SLICE)):
            sets = list(_sets(batch.column("_text"), k))
            yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    # Only one row of each node in a component is read again. Ids may repeat, so the set's own key decides.
    ids = cut(wanted.select("want_id").distinct())
    again = docs.select("doc_id", F.col("text").alias("_text")).join(small(ids), F.col("doc_id").eqNullSafe(F.col("want_id")), "left_semi")
    sets = again.select("_text").mapInArrow(read_sets, "key binary, set binary")
    members = sets.join(wanted.select("node", "root"), sets["key"] == F.col("node")).select("node", "root", "set").dropDuplicates(["node"])
    checked = cut(_tiles(cut(members), similar))
    counts = checked.where("to IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    true = components(checked.where("to IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")))
    true = cut(true.union(true.select(F.col("root").alias("node"), "root").distinct()))
    named = nodes.select("node", "first_id", "first_row", "copies").join(true, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node"))["node"].alias("lead"))
    judged = named.join(classes, "root").join(counts, "node", "left").select(
        "node", F.col("class_id").cast(kind).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"), F.when(F.col("lead") == F.col("node"), F.col("first_row")).alias("lead"))
    return rows.select("doc_id", "node", "n", "row").join(judged, "node").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links",
        F.when(F.col("n") > 0, F.col("n_copies")).otherwise(F.lit(1)).alias("n_copies"),
        ((F.col("n") == 0) | F.coalesce(F.col("lead") == F.col("row"), F.lit(False))).alias("kept"))
