"""Every license rule against brute force, and texts with very many matches."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from portrisk.llm import licenses


def brute(text: str):
    """All detections of the rules, and those that no other one contains, by comparing all of them."""
    found = []
    for n, r in enumerate(licenses.rules()):
        if r.keyword in text and (not r.hints or any(h in text for h in r.hints)):
            for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", text):
                found.append((n, r.priority, r.label, text[: m.start()].count(" "), text[: m.end()].count(" ")))

    def beaten(d, e):
        inside = e[1] >= d[1] and e[3] <= d[3] and e[4] >= d[4]
        return inside and ((e[3], -e[4], -e[1], e[0]) < (d[3], -d[4], -d[1], d[0]))

    return found, [d for d in found if not any(beaten(d, e) for e in found if e is not d)]


def plain(pattern: str) -> str:
    """Words that a pattern of the rules matches: first ways of choices, without what may be left out."""
    while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\??)", lambda m: "" if m[2] else m[1], pattern)) != pattern:
        pattern = new
    pattern = pattern.split("|")[0]
    pattern = re.sub(r"\.\{(\d+),\d+\}", "some", re.sub(r"\[([^\]])[^\]]*\](?:\{(\d)\})?", lambda m: m[1] * int(m[2] or 1), pattern))
    return re.sub(r" +", " ", re.sub(r".\?", "", pattern)).strip()


def test_rules_against_brute_force(spark):
    r = random.Random(3)
    phrases = [plain(x.pattern) for x in licenses.rules()]
    texts = phrases + [" ".join(r.choice([*phrases, "some words", "license", "in the"]) for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == len(texts)
    met = set()
    for row in rows:
        found, kept = brute(texts[row.doc_id])
        met |= {n for n, *_ in found}
        base = [d for d in found if d[0] < len(licenses.BASE)]
        assert row.n_base == len(base) and row.labels == ",".join(sorted({d[2] for d in (*base, *kept)})), texts[row.doc_id]
        assert sorted((d.label, d.p, d.a, d.b) for d in row.detections) == sorted((label, p, a, b) for _, p, label, a, b in kept)
    assert len(met) >= 0.95 * len(phrases)


def test_a_hundred_thousand_matches_in_a_text(spark):
    texts = [(1, "cc by nc " * 100_000), (2, "plain words"), (3, "under the mit license, " * 700)]
    start = time.time()
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("kept", F.size("detections")).drop("detections").collect()}
    assert time.time() - start < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].kept) == (100_000, 0, 299_997, 100_000)
    assert got[2].n_base == 0 and (got[3].n_base, got[3].last_word, got[3].kept) == (700, 4 * 699, 700)
