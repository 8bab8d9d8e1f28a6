"""Near duplicates by SimHash: fingerprints that differ in few bits, found by segment bit counts.

A fingerprint is cut into SEGMENTS segments. The vector of their bit counts is an embedding under which
Manhattan distance never exceeds Hamming distance, so links (at most BITS = 2 differing bits) lie within
Manhattan distance 2. The range join works on a grid over that vector: its coordinates form three groups,
and of a distance of 2 over three groups one has none and the next in turn at most one. So a cell is named by
two groups (first, next), every fingerprint is stored in three cells and looks into those one step up in one
coordinate of `next`; from the other side the step is down. Pairs of a cell are then compared bit by bit.

A cell with more than CROWD fingerprints (a crowd of near copies) is not compared pair by pair: its
fingerprints, and those that look into it, meet at the values one bit away from them. Two fingerprints link
exactly if they share such a value or are one; a value has at most 65 of them. So no cell is ever work
that grows with its square, and no link is lost.

Copies share a fingerprint and travel as one. A null or empty text, or one without a word, has fingerprint
zero, linked like any other; fewer than three words are one shingle. A null id has a row of its own and never
names a component; a component of null ids only has a null component_id. Repeated rows stay. Empty tables
give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk.llm.common import cut, small
from portrisk.llm.components import components
from portrisk.llm.words import slices

SHINGLE = 3
SEED = 42
BITS = 2
SEGMENTS = 32
CROWD = 256
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_ODD = 0x5555555555555555
#: First segment of each of the three groups, and the end.
_GROUPS = (0, 11, 22, SEGMENTS)


def _word_parts(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time; a part ends behind white space."""
    at = 0
    while at < len(text):
        to = min(at + PART, len(text))
        if to < len(text):
            last = max(text.rfind(bytes([c]), at, to) for c in _SPACE)
            if last < 0:  # a very long word
                ends = [p for p in (text.find(bytes([c]), to) for c in _SPACE) if p >= 0]
                last = min(ends, default=len(text) - 1)
            to = last + 1
        yield text[at:to].lower().split()
        at = to


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: the bits set in over half of its shingles' hashes."""
    from xxhash import xxh64_intdigest

    counts, n, rest = np.zeros(64, dtype=np.int64), 0, []

    def add(grams: list[bytes]) -> None:
        nonlocal n
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=len(grams))
        counts[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(grams)

    for words in _word_parts(text):
        words = rest + words
        if len(words) >= SHINGLE:
            add([b" ".join(g) for g in zip(*(words[k:] for k in range(SHINGLE)), strict=False)])
        rest = words[-(SHINGLE - 1):]
    if n == 0 and rest:
        add([b" ".join(rest)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (64 bits, signed) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                fps = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([some.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bit_counts(fp: Column) -> Column:
    """Bit counts of 32 segments of two bits, packed in two bits each."""
    odd, high = F.lit(_ODD), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseXOR(high).bitwiseAND(odd))


def _group_mask(group: int) -> int:
    return sum(3 << (2 * s) for s in range(_GROUPS[group], _GROUPS[group + 1]))


def _cells(vector: Column) -> Column:
    """The cells of a fingerprint: stored in one for each pair of groups, looking into those one step up."""
    cells = []
    for first in range(3):
        after = (first + 1) % 3
        base = vector.bitwiseAND(F.lit(_signed(_group_mask(first) | _group_mask(after))))
        cells.append(F.struct(F.lit(first).alias("pair"), base.alias("at"), F.lit(True).alias("stored")))
        for s in range(_GROUPS[after], _GROUPS[after + 1]):
            count = F.shiftrightunsigned(vector, 2 * s).bitwiseAND(F.lit(3))
            for k, change in ((0, 1), (1, 3)):  # from 0 to 1 and from 1 to 2; a count of 2 is the most
                up = base.bitwiseXOR(F.lit(_signed(change << (2 * s))))
                cells.append(F.when(count == k, F.struct(F.lit(first).alias("pair"), up.alias("at"), F.lit(False).alias("stored"))))
    return F.array(*cells)


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs a, b of a table of distinct fingerprints fp that connect all that link: in small cells every link, in crowds enough of them."""
    cells = distinct.select("fp", _bit_counts(F.col("fp")).alias("v")).select("fp", F.explode(_cells(F.col("v"))).alias("cell"))
    rows = cells.where("cell IS NOT NULL").select("cell.*", "fp")
    crowded = cut(rows.where("stored").groupBy("pair", "at").count().where(F.col("count") > crowd).select("pair", "at", F.lit(True).alias("crowded")))
    rows = rows.join(small(crowded), ["pair", "at"], "left")

    calm = rows.where("crowded IS NULL")
    stored = calm.where("stored").select("pair", "at", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= BITS
    # Two stored ones meet twice, one that looks meets a stored one once.
    pairs = calm.join(stored, ["pair", "at"]).where((F.col("fp") < F.col("b")) | (~F.col("stored") & (F.col("fp") != F.col("b")))).where(near)
    pairs = pairs.select(F.col("fp").alias("a"), "b")

    dense = rows.where("crowded").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    dense = dense.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))
    dense = dense.withColumn("b", least).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(dense).distinct()


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id in reach, for every row."""
    rows = cut(fingerprints(docs))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), crowd))
    # Fingerprints of components; all others stand alone.
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = cut(member)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select(F.col("fp").alias("fp_"), "component_id")
    return rows.join(named, F.col("fp") == F.col("fp_")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
