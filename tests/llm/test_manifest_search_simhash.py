"""The Merkle manifest, the ranked search and SimHash against brute force, with edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from portrisk.llm import merkle, ranked_search, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t\n", None, "a", 6), (4, "one", "en", None, 3), (4, "one", "en", None, 3),
    (None, "no id here at all, but Words", "en", "a", 20), (5, "X " * 30_000, "en", "a", 60_000), (6, "12 34 !?", "en", "b", 8), (4, "One two", "en", "b", 7),
]
SMALL = [
    [(7, "Only Row", "en", "a", 8)], [(k, f"Text {k}", "en", "a", 1) for k in range(9)], [(k, f"T {k}", f"l{k}", "a", 1) for k in range(10)],
]


def many(seed: int = 1):
    r = random.Random(seed)
    langs = ["en"] * 12 + ["de", "fr", None, "zz", "É", "a", "b", "c", "d", "e"]
    return [(r.randrange(700), r.choice(["Aa", "bb", None, "Über"]), r.choice(langs), r.choice(["s", None]), r.randrange(9)) for _ in range(1500)]


def frame(spark, rows):
    return spark.createDataFrame(list(rows), DOCS)


def hashed(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower: bool = False) -> str:
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda c: c[0].lower(), text)
    return hashed("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(levels[-1][i: i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(trees[x], key=lambda row: (row[0] is not None, row[0] or 0, leaf(row))) for x in names}
    levels = {x: climb([leaf(row) for row in trees[x]]) for x in names}
    top = climb([levels[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for p, row in enumerate(trees[x]):
            own = leaf(row)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded, siblings = leaf(row, lower=changed), []
            for tree, at in ((levels[x], p), (top, k)):
                for level in tree[:-1]:
                    run, i = level[at // 8 * 8: at // 8 * 8 + 8], at % 8
                    siblings += run[:i] + run[i + 1:]
                    folded, at = hashed(run[:i] + [folded] + run[i + 1:]), at // 8
            out.append((row[0], own, levels[x][-1][0], top[-1][0], hashed(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ODD, many(), *SMALL], ids=["odd", "many", "one", "nine", "ten_trees"])
def test_manifest_equals_brute_force(spark, rows):
    got = merkle.verify(merkle.manifest(frame(spark, rows)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_no_rows_and_with_other_columns(spark):
    assert merkle.verify(merkle.manifest(frame(spark, []))).collect() == []
    more = frame(spark, ODD)
    for name in ("leaf", "tree", "n", "pos", "block", "seq", "part", "digest", "shown", "proof", "at_"):
        more = more.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, merkle.verify(merkle.manifest(more)).collect()), key=repr) == brute_manifest(ODD)


def test_missing_coordinates_are_enough_and_none_can_be_derived():
    r = random.Random(5)
    for n in (1, 2, 8, 9, 64, 65, 500):
        for _ in range(20):
            leaves = sorted(r.sample(range(n), r.randint(1, min(n, 9))))
            size, known, at = n, set(leaves), dict(merkle.missing(np.array(leaves), n))
            for level in range(merkle.height(n)):
                fetched = set(at[level].tolist())
                assert not fetched & known
                need = {c for p in known for c in range(p // 8 * 8, min(size, p // 8 * 8 + 8))}
                assert need == known | fetched
                size, known = -(-size // 8), {p // 8 for p in known}


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(rows, items, k=10):
    terms = [Counter(TERM.findall((row[1] or "").encode().lower())) for row in rows]
    lengths = [sum(t.values()) for t in terms]
    n_docs, total = sum(map(bool, terms)), sum(lengths)
    df = Counter(t for doc in terms for t in doc)
    weight = {t: floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item_id, text in items:
        found = []
        for row, doc, n in zip(rows, terms, lengths, strict=True):
            m = 10 + (90 * n * n_docs) // total if total else 0
            score = sum(weight[t] * ((10**9 * doc[t]) // (1000 * doc[t] + 8 * m)) for t in set(TERM.findall((text or "").encode().lower())) if doc[t])
            if score > 0:
                found.append((-score, row[0] is None, row[0] or 0, row[0]))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def prose(seed: int, n: int):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=r.randint(1, 60))), "en", "a", 1))
    rows += [(n + j, rows[3][1], "en", "a", 1) for j in range(40)]  # a group of copies
    rows += [(1000 + j, "W1 " * 300 + "w7", "en", "a", 1) for j in range(3)]
    return rows


ITEMS = [(1, "w1 w2 W300 w7, w7"), (1, "w1 w2 W300 w7, w7"), (1, "other w399"), (2, None), (3, ""), (4, "never seen"), (None, "w5 w6"), (5, "one two no id"), (6, "w1")]


@pytest.mark.parametrize("maps", ["wide", "narrow"])
def test_search_equals_brute_force(spark, monkeypatch, maps):
    if maps == "narrow":  # bounds far above the scores must not change the result
        monkeypatch.setattr(ranked_search, "WIDTH", 1)
        monkeypatch.setattr(ranked_search, "HELD", 8)
    rows = prose(2, 300) + ODD
    queries = spark.createDataFrame(ITEMS + [(10, rows[3][1]), (11, rows[9][1])], "item_id long, text string")
    got = ranked_search.search(frame(spark, rows), queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, ITEMS + [(10, rows[3][1]), (11, rows[9][1])])


def test_search_in_many_blocks_and_of_nothing(spark):
    rows = prose(4, 60)
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = ranked_search.Search(frame(spark, rows)).search(queries, block_terms=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_search(rows, ITEMS)
    assert ranked_search.search(frame(spark, []), queries).collect() == []
    assert ranked_search.search(frame(spark, rows), queries.limit(0)).collect() == []
    assert ranked_search.search(frame(spark, [(1, None, None, None, None)]), queries).collect() == []
    clash, same = frame(spark, rows), queries
    for name in ("n", "term", "sketch", "asked", "key", "query", "score", "rank", "id_", "df", "item_id"):
        clash = clash.withColumn(name, F.lit("x"))
    for name in ("doc_id", "n", "key", "term", "rank", "score", "block"):
        same = same.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, ranked_search.search(clash, same).collect()), key=repr) == brute_search(rows, ITEMS)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows of (id, fingerprint)."""
    distinct = sorted({fp for _, fp in rows})
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            least[find(fp)] = min(least.get(find(fp), doc_id), doc_id)
    return sorted(((doc_id, f"{fp:016x}", least.get(find(fp))) for doc_id, fp in rows), key=repr)


def test_fingerprint_of_whole_texts_in_parts(monkeypatch):
    texts = [None, "", " \n", "one", "One two", "a b c", "A b  c\td\x0be\x0cf\rg\x1ch", "é É ß", "x" * 200 + " y " + "z" * 90, "w1 w2 w3 w4 w5 " * 30]
    for part in (1 << 20, 7, 40):
        monkeypatch.setattr(simhash, "PART", part)
        assert [simhash.fingerprint((t or "").encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_simhash_of_odd_rows_and_copies(spark):
    rows = ODD + prose(6, 80) + [(-5, rows_text, "en", "a", 1) for rows_text in ("   ",)]
    want = brute_components([(row[0], brute_fingerprint(row[1])) for row in rows])
    got = simhash.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    clash = frame(spark, rows)
    for name in ("fp", "fingerprint", "component_id", "least", "root", "node", "fp_"):
        clash = clash.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, simhash.near_duplicates(clash).collect()), key=repr) == want
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [0, 3, 256])
def test_links_connect_what_differs_in_two_bits(spark, crowd):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(150)}
    for fp in list(fps)[:60]:  # pairs at one, two and three bits, at all places
        for bits in (1, 2, 3):
            fps.add(fp ^ sum(1 << b for b in r.sample(range(64), bits)))
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 12) for b in range(a)}  # a crowd
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63), (1 << 63) - 1}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    table = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp long")
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(table, crowd).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in found)
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    want = defaultdict(set)
    for i, fp, c in brute_components(rows):
        want[c].add(int(fp, 16))
    got = defaultdict(set)
    for fp in fps:
        got[find(fp)].add(fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    if crowd == 256:  # nothing is crowded: every link is listed
        assert {frozenset(x) for x in found} == {frozenset((a, b)) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= 2}


def test_a_sketch_bounds_every_count():
    r = np.random.default_rng(3)
    terms = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    tf = r.integers(1, 400, len(terms))
    one = ranked_search.unfold(np.frombuffer(ranked_search.sketch(terms, tf), dtype=np.uint8))
    seen = one[(ranked_search._coordinates(terms) & np.uint64(len(one) - 1)).astype(np.int64)].min(axis=0)
    assert (ranked_search.LEVELS[seen] >= tf).all()
