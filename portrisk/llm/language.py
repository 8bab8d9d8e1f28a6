"""Language ID by language-bitmask filters of character trigrams.

A bit-sliced Bloom filter holds, at every position, one bit per language; the AND of the rows that a
trigram hashes to has the bits of all languages that contain it. A text's hits per language are
corrected for the share of false positives that the fill of each slice implies, and the largest
corrected count decides. The score is that count over the text's trigrams (0 to 1).

Learning: trigrams (of letters in lower case, a gap at word ends) of labelled rows. At most about
SAMPLE ids a language, chosen by a hash, are read, with one text each (of rows with equal ids the least
text); a language contains a trigram that has at least MIN_SHARE of its trigrams and KEEP of the
trigram's largest share in any language.

Edge cases: a null text or one without a letter is `und` with score 0; texts of unknown trigrams get
the most frequent learned language with score 0; without any labelled row all are `und`; a null
doc_id is never held out and never learned from; an empty table gives an empty result. Long texts are
read in pieces that end between words; a run of letters longer than WORD may be cut inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import bound_batches, sampled
from portrisk.llm.words import mix, slices

SAMPLE = 3000
MIN_SHARE = 2e-5
KEEP = 0.1
POSITIONS = 1 << 18
PROBES = 2
#: Characters in numpy at a time.
BLOCK = 1 << 18
#: Letters by which a piece of a long text may be longer, to end between words.
WORD = 1 << 12
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Every code point to itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the texts, packed into 63 bits, and the number of the text each is from."""
    points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Lower case may change lengths, so texts are found by their separators.
    ends = np.flatnonzero(points == 10)
    inner = np.fromiter((t.count("\n") for t in texts), dtype=np.int64, count=len(texts))
    ends = ends[np.cumsum(inner + 1)[:-1] - 1] if len(texts) > 1 else ends[:0]
    code = np.concatenate([[0], _letters()[points], [0]]).astype(np.int64)
    keep = (code != 0) | (np.concatenate([[1], code[:-1]]) != 0)
    owner = np.searchsorted(ends, np.arange(len(code)) - 1, side="left")[keep]
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    inside = code[1:-1] != 0
    return grams[inside], owner[1:-1][inside]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most BLOCK characters, a longer text alone: number of the first one, texts."""
    some, at, size = [], 0, 0
    for n, t in enumerate(texts):
        if some and size + len(t or "") > BLOCK:
            yield at, some
            some, at, size = [], n, 0
        some.append(t or "")
        size += len(some[-1])
    if some:
        yield at, some


def _pieces(text: str) -> Iterator[str]:
    """A very long text in pieces that end at a character that is no letter, where there is one."""
    at = 0
    while at < len(text):
        to = end = min(at + BLOCK, len(text))
        while to < min(end + WORD, len(text)) and text[to - 1].isalpha():
            to += 1
        yield text[at:to]
        at = to


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts of a block at once, or the pieces of its only text one by one."""
    if len(texts) == 1:
        yield from ([piece] for piece in _pieces(texts[0]))
    else:
        yield texts


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    default: int
    table: np.ndarray  # positions x words of 64 languages
    false_rate: np.ndarray

    @staticmethod
    def build(sets: dict[str, np.ndarray], default: str, positions: int = POSITIONS, probes: int = PROBES) -> LanguageFilter:
        languages = tuple(sorted(sets))
        table = np.zeros((positions, max(1, (len(languages) + 63) // 64)), dtype=np.uint64)
        rate = np.zeros(len(languages))
        for n, lang in enumerate(languages):
            for p in places(sets[lang], positions, probes):
                table[p, n // 64] |= np.uint64(1 << (n % 64))
            rate[n] = np.mean((table[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1)) ** probes
        return LanguageFilter(languages, languages.index(default), table, rate)

    def masks(self, grams: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Bits of all languages that contain each trigram."""
        found = None
        for p in places(grams, len(self.table), probes):
            found = self.table[p] if found is None else found & self.table[p]
        return found

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and hits by text and language."""
        counts, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for part in _parts(texts):
            grams, of = trigrams(part)
            counts += np.bincount(of, minlength=len(texts))
            masks = self.masks(grams)
            for n in range(len(self.languages)):
                hits[:, n] += np.bincount(of, (masks[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1), minlength=len(texts))
        return counts, hits

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, hits = self.hits(texts)
        right = np.maximum(0, (hits - counts[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)))
        right[:, self.default] += 1e-9  # the most frequent language where nothing is known
        best = right.argmax(axis=1)
        score = np.clip(right[np.arange(len(texts)), best] / np.maximum(counts, 1), 0, 1).round(6)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)], np.where(counts > 0, score, 0.0)


def places(grams: np.ndarray, positions: int, probes: int) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64))
    return [((h >> np.uint64(k * 64 // probes)) % np.uint64(positions)).astype(np.int64) for k in range(probes)]


def held_out(doc_id: Column) -> Column:
    """True for ids that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageFilter | None:
    """The filter from rows that are labelled and not held out; None without such rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return None
    taken = F.lit(False)
    for lang, n in share.items():
        taken = F.when(F.col("lang") == lang, sampled(F.col("doc_id"), n, sample)).otherwise(taken)
    # One text an id: an id of very many rows does not outgrow the sample.
    chosen = rows.where(taken).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
            for lang in np.unique(langs):
                for part in (p for _, block in _blocks([texts[i] for i in np.flatnonzero(langs == lang)]) for p in _parts(block)):
                    grams, n = np.unique(trigrams(part)[0], return_counts=True)
                    yield pa.record_batch([pa.array([str(lang)] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    parts = counts.join(F.broadcast(totals), "lang").withColumn("part", F.col("n") / F.col("total"))
    best = parts.where(F.col("part") >= MIN_SHARE)  # at most 1 / MIN_SHARE trigrams a language
    got = best.select("lang", "gram", "part").toPandas()
    top = got.groupby("gram")["part"].transform("max")
    got = got[got["part"] >= KEEP * top]
    sets = {lang: got.loc[got["lang"] == lang, "gram"].to_numpy() for lang in share}
    return LanguageFilter.build(sets, max(share, key=lambda k: (share[k], k)))


def identify(docs: DataFrame, model: LanguageFilter | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of every row, with lang_pred and score (under names) of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    text = "text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (x for b in batches for x in slices(b, text)):
            langs: list[str] = []
            scores: list[float] = []
            for _, part in _blocks(batch.column(text).to_pylist()):
                a, b = own.decide(part) if own else ([UNKNOWN] * len(part), [0.0] * len(part))
                langs += a
                scores += list(b)
            columns = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch(columns, names=[*keep, *names])

    source = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")
