"""Near-duplicate lines by an exact set-similarity join, and their removal.

A line is the set of its words; lines at Jaccard similarity SIMILAR or more match, and a line goes when an
earlier one (by doc_id, then by line number) matches it, removed itself or not.

1. Lines with equal sets in one partition, then in all, become one set with its first place.
2. Words are ordered by rarity: counts of all words of the corpus in a table of 2^RARITY_BITS cells. Any fixed
   order gives exact results, so words that share a cell only cost time. A word seen once can't be shared
   and is left out of the postings.
3. Prefix filter: matching sets share one of their first n - ceil(SIMILAR n) + 1 words. Postings meet by word under
   the length filter, the positional filter, and a bound from 128-bit parities of the sets: the words in
   which two sets differ are at least the bits in which their parities do. All three are lossless. A set needs one
   earlier match only, so each posting yields one candidate at most, never all pairs of a group. A task sends its
   postings as Arrow batches, one for each range of words.
4. The lines of candidate pairs are read again and compared exactly. Sets whose candidates all fail meet all of theirs.
   Only the lines asked for leave the task that reads their document.

Edge cases: lines without a word and null texts are never removed or matched; rows with equal ids share their
places, so they lose lines to smaller ids and lines only; a null id comes before all others, and its rows lose no
line; a document that loses all lines becomes an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import bound_batches, cut, fresh, small, sorted_chunks, sorted_groups
from portrisk.llm.words import column_words, mix, slices, text_buffer, words_of

SIMILAR = 0.8
RARITY_BITS = 22
BLOCK_BITS = 12
#: Postings of a word above which they are dealt out by the sizes of the pairs as well, and in parts of TILE postings.
HOT = 20_000
TILE = 5_000
POSTING = ("doc_id", "line", "n_at", "p0", "p1")
#: Ranges of words at least, postings of a range above that, and postings that a task sends at once.
RANGES = 1024
RANGE = 500_000
AT_ONCE = 1_000_000
#: Ranges whose postings are copied at once, of those a task sends.
RANGES_AT_ONCE = 64
#: Bytes of text that a task works on at once; its arrays of a number a word hold about 20 times as much.
SLICE = 1 << 20
#: Removed line numbers that may be broadcast: 16 MB.
BROADCAST_LINES = 4_000_000


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words line by line: hashes, where each line begins, its row, its number in the row. Lines without words are left out."""
    data, offsets = text_buffer(column)
    low, high = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[low:high] == 10) + low
    words, starts = words_of(data, np.unique(offsets))
    edges = np.unique(np.concatenate([offsets, breaks]))
    line = np.searchsorted(edges, starts, side="right")
    order = _order(line, words)
    words, line, starts = words[order], line[order], starts[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    words, line, starts = words[new], line[new], starts[new]
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts[at], side="right") - 1
    number = np.searchsorted(breaks, starts[at], side="left") - np.searchsorted(breaks, offsets[row], side="left")
    return words, np.append(at, len(words)), row, number


def _order(line: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by line, then by the upper bits of value: one sort of one number, much faster than a sort by two."""
    bits = int(line[-1] - line[0] + 1).bit_length() if len(line) else 1
    return np.argsort((line - line[0]).astype(np.uint64) << np.uint64(64 - bits) | value >> np.uint64(bits)) if len(line) else np.zeros(0, np.int64)


def _set_keys(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each line's distinct words."""
    if len(at) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.add.reduceat(mix(words + np.uint64(1)), at[:-1]), np.add.reduceat(mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1])


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of the words of each cell, over all documents, by classes: 0 none, 1 one, above by eighths of powers of two.

    A task sends its cells in compressed blocks, and a block is summed as its rows stream by.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, dtype=np.uint32)
        for batch in (x for b in batches for x in slices(b, "_text", SLICE)):
            cells, times = np.unique((column_words(batch.column("_text"))[0] >> np.uint64(64 - RARITY_BITS)).astype(np.uint32), return_counts=True)
            total[cells] = np.minimum(total[cells] + times, 0xFFFFFFFF)
        blocks = total.reshape(-1, 1 << BLOCK_BITS)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch([pa.array(some), pa.array([pa.compress(blocks[i].tobytes(), codec="zstd", asbytes=True) for i in some], pa.binary())], names=["block", "cells"])

    def classes(block: int, total: np.ndarray) -> pa.RecordBatch:
        kind = np.where(total, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)
        return pa.record_batch([pa.array([block]), pa.array([kind.tobytes()], pa.binary())], names=["block", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                if block != now:
                    if now is not None:
                        yield classes(now, total)
                    now, total = block, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                total += np.frombuffer(pa.decompress(cells.as_buffer(), decompressed_size=4 << BLOCK_BITS, codec="zstd"), dtype=np.uint32)
        if now is not None:
            yield classes(now, total)

    counts = docs.select(F.col("text").alias("_text")).mapInArrow(run, "block long, cells binary")
    blocks = counts.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block long, cells binary")
    out = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
    bound_batches(docs.sparkSession)
    for r in blocks.collect():  # at most 2^RARITY_BITS bytes, whatever the corpus
        out[r["block"] << BLOCK_BITS: (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["cells"], dtype=np.uint8)
    return out


def _line_sets(docs: DataFrame, counts, similar: float) -> DataFrame:
    """A row for each line: key, place, number of words, parities, and the prefix words that others may share.

    text_key tells rows with equal ids apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        for batch in (x for b in batches for x in slices(b, "_text", SLICE)):
            words, at, row, number = _lines(batch.column("_text"))
            if len(at) < 2:
                continue
            h1, h2 = _set_keys(words, at)
            n = np.diff(at)
            line = np.repeat(np.arange(len(n)), n)
            bit = words & np.uint64(127)
            parity = [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), at[:-1]) for half in (0, 1)]
            count = rarity[(words >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
            order = _order(line, words >> np.uint64(8) | count.astype(np.uint64) << np.uint64(56))
            place = np.arange(len(words)) - at[:-1][line]
            prefix = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
            chosen = (place < prefix[line]) & (count[order] > 1)
            words, of = words[order][chosen], line[chosen]
            edges = np.searchsorted(of, np.arange(len(n) + 1))
            # 32 bits of each word; equal bits of two words only let more through the filters. The words left out are
            # the rarest, so the others have the places from skip on.
            posts = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((words >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.record_batch([
                *[batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")], pa.array(number.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                pa.array(n.astype(np.int32)), pa.array((prefix - np.diff(edges)).astype(np.int32)), pa.array(parity[0].view(np.int64)), pa.array(parity[1].view(np.int64)), posts],
                names=["doc_id", "text_key", "line", "h1", "h2", "n", "skip", "p0", "p1", "posts"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_key long, line int, h1 long, h2 long, n int, skip int, p0 long, p1 long, posts array<int>")


def _postings(sets: DataFrame) -> DataFrame:
    return sets.select("first", "n", "skip", "p0", "p1", F.posexplode("posts").alias("at", "word")).select(
        "word", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"),
        (F.shiftleft(F.col("n").cast("long"), 32) + F.col("skip") + F.col("at")).alias("n_at"), "p0", "p1")


def _placed(posts: DataFrame, similar: float) -> DataFrame:
    """Postings of hot words with the smaller size of their pairs (m) and the part of that group, of how many. No pair that passes the filters is lost.

    A posting goes to its own size, if a set as large can have the words needed after its place, and to those smaller
    ones that the length and positional filters allow. A group whose postings are all of larger sets has no pair there.
    """
    n, rest = F.shiftright("n_at", 32).cast("long"), F.shiftright("n_at", 32) - F.col("n_at").bitwiseAND(0xFFFFFFFF)
    # The words needed are at most rest: solved for the other size, with some slack.
    most = F.floor(rest * ((1 + similar) / similar) - n + F.lit(1e-6)).cast("long")
    low, high = F.greatest(F.lit(1), F.ceil(n * similar - F.lit(1e-6)).cast("long")), F.least(n, most)
    sized = posts.withColumn("m", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    sizes = cut(sized.groupBy("word", "m").agg(F.count(F.lit(1)).alias("all"), F.sum((n == F.col("m")).cast("long")).alias("own")).where("own > 0 AND all > 1").select(
        F.col("word").alias("w"), F.col("m").alias("size"), F.ceil(F.col("all") / TILE).cast("int").alias("parts")))
    return sized.join(small(sizes), (F.col("word") == F.col("w")) & (F.col("m") == F.col("size"))).drop("w", "size").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "line"), F.col("parts")).cast("int"))


def _first_candidates(sets: DataFrame, similar: float) -> DataFrame:
    """For each set and shared prefix word, an earlier set that passes the filters, if there is any.

    Postings of a hot word first meet inside parts of bounded size. Those that find no candidate there meet all other
    parts, also by tiles of bounded size; the others have theirs.
    """
    posts = _postings(sets)
    # The share that is counted decides how the work is dealt out, not what is found.
    rate = max(1, HOT // 300)
    hot = cut(posts.where(F.pmod(F.xxhash64("doc_id", "line"), F.lit(rate)) == 0).groupBy("word").count().where(F.col("count") > HOT // rate).select("word"))
    # At most one word in HOT postings.
    cold = _compare_ranges(sets, np.array([r.word for r in hot.collect()], dtype=np.int32), similar)
    if hot.isEmpty():
        return cold.distinct()
    placed = cut(_placed(posts.join(small(hot), "word", "left_semi"), similar).withColumn("g", F.xxhash64("word", "m", "part")))
    inner = cut(_compare(placed.select("g", F.lit(True).alias("seek"), *POSTING), similar))
    done = inner.select(F.col("g").alias("dg"), F.struct(F.col("b_id").alias("doc_id"), F.col("b_line").alias("line")).alias("first")).distinct()
    left = cut(placed.where("parts > 1").join(done, (F.col("g") == F.col("dg")) & (F.struct("doc_id", "line") == F.col("first")), "left_anti"))
    tiles = cut(left.groupBy("word", "m").count().select("word", "m", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    later = left.join(small(tiles), ["word", "m"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part").select(
        F.xxhash64("word", "m", "other", F.pmod(F.xxhash64("line", "doc_id"), F.col("tiles")).cast("int")).alias("g"), F.lit(True).alias("seek"), *POSTING)
    earlier = placed.join(small(tiles), ["word", "m"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64("word", "m", "part", "tile").alias("g"), F.lit(False).alias("seek"), *POSTING)
    outer = _compare(later.union(earlier), similar)
    return cold.union(inner.union(outer).drop("g")).distinct()


def _earlier(part: pa.Table, group: np.ndarray, seek: np.ndarray, similar: float) -> tuple[pa.Array, pa.Array]:
    """Numbers of an earlier posting of the same group that passes the filters, and of the seeking one, for those that find one.

    The sets of a group come in order of place. Each is compared with the one before it, then with the one before that,
    until a candidate is found: near copies of one line find each other at once, so pairs stay in proportion to the sets.
    """
    n = (part.column("n_at").to_numpy() >> 32).astype(np.int64)
    rest = n - (part.column("n_at").to_numpy() & 0xFFFFFFFF)
    p0, p1 = (part.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1"))
    # The length and positional filters solved for the other size, with some slack.
    low = np.ceil(similar * n - 1e-6).astype(np.int32)
    most = np.minimum(np.floor(rest * ((1 + similar) / similar) - n + 1e-6), 0x7FFFFFFF).astype(np.int32)
    high = np.minimum(np.floor(n / similar + 1e-6), most).astype(np.int32)
    size = n.astype(np.int32)
    # Those that have most postings before them come first, so that those still to be compared are a run.
    before = np.arange(len(group)) - np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
    b = np.flatnonzero((before > 0) & seek & (low <= high))
    b = b[np.argsort(-before[b], kind="stable")]
    found_a, found_b, lag, gone = [], [], 1, np.zeros(len(b), dtype=bool)
    sizes, lows, highs, firsts = size[b], low[b], high[b], p0[b]
    ends = np.searchsorted(-before[b], -np.arange(1, before.max(initial=0) + 2), side="right")
    while (k := ends[lag - 1]) > 0:
        a = b[:k] - lag
        other = size.take(a, mode="clip")
        some = np.flatnonzero((other >= lows[:k]) & (other <= highs[:k]))
        some = some[(most.take(a.take(some), mode="clip") >= sizes[some]) & ~gone[some]]
        # Half of the parities rejects most of them.
        some = some[np.bitwise_count(p0.take(a.take(some)) ^ firsts.take(some)) <= (other.take(some) + sizes.take(some)) * ((1 - similar) / (1 + similar)) + 1e-6]
        if len(some):
            x, y = a[some], b[some]
            need = np.ceil((n[x] + n[y]) * (similar / (1 + similar)) - 1e-9)
            differ = np.bitwise_count(p0[x] ^ p0[y]).astype(np.int64) + np.bitwise_count(p1[x] ^ p1[y])
            ok = (np.minimum(n[x], n[y]) >= similar * np.maximum(n[x], n[y]) - 1e-9) & (np.minimum(rest[x], rest[y]) >= need) & (differ <= n[x] + n[y] - 2 * need)
            found_a.append(x[ok])
            found_b.append(y[ok])
            gone[some[ok]] = True
            if 4 * np.count_nonzero(gone[:k]) > k:
                b, sizes, lows, highs, firsts = (v[~gone] for v in (b, sizes, lows, highs, firsts))
                ends, gone = ends - np.concatenate([[0], np.cumsum(gone)])[ends], np.zeros(len(b), dtype=bool)
        lag += 1
    x, y = (pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (found_a, found_b))
    return x, y


def _by_range(sets: DataFrame, ranges: int, hot: np.ndarray) -> DataFrame:
    """The postings of all words but the hot ones: rows of a range of words and an Arrow batch of postings."""
    def send(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(waiting).combine_chunks()
        lists = part.column("posts").combine_chunks()
        word, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        of = np.repeat(np.arange(len(length), dtype=np.int32), length)
        at = np.arange(len(word), dtype=np.int32) + (part.column("skip").to_numpy() - np.cumsum(length) + length).astype(np.int32)[of]
        cold = np.flatnonzero(~np.isin(word, hot)) if len(hot) else np.arange(len(word))
        order = cold[np.argsort(word.view(np.uint32)[cold])]
        word, of, at = word[order], of[order], at[order]
        found = (word.view(np.uint32).astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else np.zeros(1, np.int64)
        rows, n = part.select(["doc_id", "line", "p0", "p1"]), part.column("n").to_numpy().astype(np.int64) << 32
        packed = []
        for k in range(0, len(edges) - 1, RANGES_AT_ONCE):
            bounds = edges[k: k + RANGES_AT_ONCE + 1]
            here = slice(bounds[0], bounds[-1])
            posts = rows.take(pa.array(of[here])).append_column("word", pa.array(word[here])).append_column("n_at", pa.array(n[of[here]] + at[here])).combine_chunks()
            for x, y in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, posts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(posts.slice(x, y - x))
                packed.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(found[edges[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["range", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column("posts").flatten())
            if size >= AT_ONCE:
                yield send(waiting)
                waiting, size = [], 0
        if size:
            yield send(waiting)

    return sets.select("first.doc_id", "first.line", "n", "skip", "p0", "p1", "posts").mapInArrow(run, "range int, posts binary")


def _compare_ranges(sets: DataFrame, hot: np.ndarray, similar: float) -> DataFrame:
    """For each posting of a word that is not hot, an earlier one of the word that passes the filters, if there is any."""
    def meet(waiting: list[pa.Table]) -> pa.RecordBatch:
        part = pa.concat_tables(waiting)
        part = part.take(pc.sort_indices(part, [("word", "ascending"), ("doc_id", "ascending"), ("line", "ascending")], null_placement="at_start")).combine_chunks()
        x, y = _earlier(part, part.column("word").to_numpy(), np.ones(len(part), dtype=bool), similar)
        columns = [part.column(c).combine_chunks() for c in ("doc_id", "line")]
        return pa.record_batch([*[c.take(x) for c in columns], *[c.take(y) for c in columns]], names=["a_id", "a_line", "b_id", "b_line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for group in sorted_groups(batches, ("range",)):  # small ranges together
            waiting += [pa.ipc.open_stream(x.as_buffer()).read_all() for x in group.column("posts")]
            size += sum(map(len, waiting[-len(group):]))
            if size >= RANGE // 4:
                yield meet(waiting)
                waiting, size = [], 0
        if waiting:
            yield meet(waiting)

    total = sets.agg(F.sum(F.size("posts"))).first()[0] or 0
    kind = sets.schema["first"].dataType["doc_id"].dataType.simpleString()
    return _by_range(sets, max(RANGES, total // RANGE), hot).repartition("range").sortWithinPartitions("range").mapInArrow(run, f"a_id {kind}, a_line int, b_id {kind}, b_line int")


def _compare(posts: DataFrame, similar: float) -> DataFrame:
    """For each posting that seeks one, an earlier one of its group (g) that passes the filters, if there is any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_chunks(batches, ("g",)):
            word = part.column("g").to_numpy()
            x, y = _earlier(part, word, part.column("seek").to_numpy(), similar)
            columns = [part.column(c).combine_chunks() for c in ("doc_id", "line")]
            yield pa.record_batch([pa.array(word).take(y), *[c.take(x) for c in columns], *[c.take(y) for c in columns]], names=["g", "a_id", "a_line", "b_id", "b_line"])

    kind = posts.schema["doc_id"].dataType.simpleString()
    return posts.repartition("g").sortWithinPartitions("g", "doc_id", "line").mapInArrow(run, f"g long, a_id {kind}, a_line int, b_id {kind}, b_line int")


def _all_candidates(sets: DataFrame, later: DataFrame, similar: float) -> DataFrame:
    """All pairs of an earlier set and one of the sets later that pass the filters."""
    n = lambda x: F.shiftright(f"{x}.n_at", 32)
    rest = lambda x: n(x) - F.col(f"{x}.n_at").bitwiseAND(0xFFFFFFFF)
    need = F.ceil((n("a") + n("b")) * (similar / (1 + similar)) - F.lit(1e-9))
    differ = F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))) + F.bit_count(F.col("a.p1").bitwiseXOR(F.col("b.p1")))
    return _postings(sets).alias("a").join(
        small(cut(_postings(later))).alias("b"), (F.col("a.word") == F.col("b.word")) & (F.struct("a.doc_id", "a.line") < F.struct("b.doc_id", "b.line"))
        & (F.least(n("a"), n("b")) >= similar * F.greatest(n("a"), n("b")) - F.lit(1e-9)) & (F.least(rest("a"), rest("b")) >= need)
        & (differ <= n("a") + n("b") - 2 * need)).select(
        F.col("a.doc_id").alias("a_id"), F.col("a.line").alias("a_line"), F.col("b.doc_id").alias("b_id"), F.col("b.line").alias("b_line")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """Keys of the later lines of the pairs of places, with the earliest place of a match; null if none reaches the similarity.

    Rows with equal ids may differ at a place: then each of them is compared, and what matches is a line of that place.
    """
    ends = pairs.select(F.col("a_id").alias("want_id"), F.col("a_line").alias("want")).union(pairs.select("b_id", "b_line"))
    wanted = cut(ends.groupBy("want_id").agg(F.collect_set("want").alias("want")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "_text", SLICE)):
            words, at, row, number = _lines(batch.column("_text"))
            if len(at) < 2:
                continue
            want = batch.column("want")
            asked = np.repeat(np.arange(len(batch)), want.value_lengths().to_numpy()) << 32 | want.flatten().to_numpy()
            some = np.flatnonzero(np.isin(row << 32 | number, asked))
            if not len(some):
                continue
            h1, h2 = _set_keys(words, at)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64))).take(pa.array(some))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row[some])), pa.array(number[some].astype(np.int32)), pa.array(h1[some].view(np.int64)), pa.array(h2[some].view(np.int64)), lists],
                                  names=["doc_id", "line", "h1", "h2", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    again = docs.select("doc_id", F.col("text").alias("_text")).join(small(wanted), F.col("doc_id").eqNullSafe(F.col("want_id"))).select("doc_id", "_text", "want")
    lines = again.mapInArrow(read, f"doc_id {kind}, line int, h1 long, h2 long, words array<long>")
    # One exchange of the words, by place, serves both joins.
    members = lines.select(F.struct("doc_id", "line").alias("place"), "h1", "h2", "words").repartition("place").dropDuplicates(["place", "h1", "h2"])
    a = members.toDF("a", "a1", "a2", "aw")
    b = members.toDF("b", "h1", "h2", "bw")
    both = F.size(F.array_intersect("aw", "bw"))
    match = both >= similar * (F.size("aw") + F.size("bw") - both) - F.lit(1e-9)
    places = pairs.select(F.struct(F.col("a_id").alias("doc_id"), F.col("a_line").alias("line")).alias("a"), F.struct(F.col("b_id").alias("doc_id"), F.col("b_line").alias("line")).alias("b"))
    return places.join(a, "a").join(b, "b").groupBy("h1", "h2").agg(F.min(F.when(match, F.col("a"))).alias("other"))


def matched_sets(docs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Keys of all sets that an earlier set matches, and the place of such a match."""
    tried = cut(_verified(docs, cut(_first_candidates(sets, similar)), similar))
    matched = tried.where("other IS NOT NULL")
    # Sets whose candidates all failed: the filters let other ones through as well, so all of theirs are tried.
    failed = cut(tried.where("other IS NULL").select("h1", "h2"))
    if failed.isEmpty():
        return matched
    open_sets = cut(sets.join(small(failed), ["h1", "h2"], "left_semi"))
    return matched.union(cut(_verified(docs, cut(_all_candidates(sets, open_sets, similar)), similar)).where("other IS NOT NULL"))


def removed_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id and number of every line that an earlier line matches."""
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(docs))
    lines = cut(_line_sets(docs, counts, similar))
    counts.destroy()  # the lines are written
    # One row for each set; of its copies in a task, only the first place travels.
    sets = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("skip").alias("skip"), F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.first("posts").alias("posts")))
    # A set of one line that nothing matches keeps it.
    limits = cut(sets.where("copies > 1").select("h1", "h2", "first").union(matched_sets(docs, sets, similar)).groupBy("h1", "h2").agg(F.min("first").alias("limit")))
    return lines.join(limits, ["h1", "h2"]).where(F.struct("doc_id", "line") > F.col("limit")).select("doc_id", "text_key", "line")


def removed_by_document(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id with the sorted numbers of its removed lines, for documents that lose any."""
    return removed_lines(docs, similar).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _with_removed(docs: DataFrame, rows: DataFrame, similar: float, id_name: str, key_name: str, removed: str) -> DataFrame:
    """rows, a selection of docs with id and text key of each, with the removed line numbers (null: none)."""
    a, b = fresh(rows, "_id", "_key")
    gone = cut(removed_by_document(docs, similar).select(F.col("doc_id").alias(a), F.col("text_key").alias(b), F.col("removed").alias(removed)))
    # Broadcast up to counted sizes, so that texts need no shuffle; else joined by shuffle.
    elements = gone.agg(F.sum(F.size(removed))).first()[0] or 0
    gone = small(gone) if elements <= BROADCAST_LINES else gone
    return rows.join(gone, F.col(id_name).eqNullSafe(F.col(a)) & (F.col(key_name) == F.col(b)), "left")


def removed_counts(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, n_removed and the removed line numbers of every row."""
    rows = docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("key_"))
    return _with_removed(docs, rows, similar, "id_", "key_", "removed").select(
        F.col("id_").alias("doc_id"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with removed lines taken out of text, n_chars renewed where there is such a column."""
    id_name, key_name, removed = fresh(docs, "id_", "key_", "removed")
    rows = docs.select("*", F.col("doc_id").alias(id_name), F.xxhash64("text").alias(key_name))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(removed, i))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = _with_removed(docs, rows, similar, id_name, key_name, removed).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
