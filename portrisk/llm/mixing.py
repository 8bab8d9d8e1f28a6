"""Mixing to target weights by soft membership.

Native: DataFrame functions only. A naive Bayes classifier on the labelled table gives every document a posterior
over domains (label combinations). Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, match the targets: least squares with a pull to rate 1,

    min  sum_d w_d (r_d - 1)^2 / 2 + sum_k (sum_d w_d p_dk r_d - t_k)^2 / (2 MU),   w_d: share of all tokens.

Each step of the projected gradient is one grouped sum over the documents: the rates are max(0, 1 - p_d . S) with a
short vector S, the driver keeps S only, so no table is rewritten and a lost executor loses nothing.

The classifier is fitted on at most about SAMPLE labelled rows of each domain, chosen by a hash of the id. Its features
are the FEATURES words (and measures of case, symbols and marks as words) that tell domains apart best.

Edge cases: null texts have no words, so rate 1 and no weight; unlabelled tables give each document the first domain;
labels of one id in several rows are merged; rows with equal ids stay separate rows; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portrisk.llm.common import cut, let, sampled

#: Domains in order: SQL over the merged columns quality and toxic; every labelled row is in one.
DOMAINS = {"toxic": "toxic = 1", "low_quality": "toxic = 0 AND quality = 0", "good": "toxic = 0 AND quality = 1"}
TARGETS = {"toxic": 0.05, "low_quality": 0.10, "good": 0.85}
SAMPLE = 3000
FEATURES = 120
MU = 1e-3
STEPS = 200
TOLERANCE = 1e-8
#: Deviation from the optimum, as a share of all tokens, above which a fit that ran out of steps is an error.
MAX_RESIDUAL = 1e-4

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _share(name: str, text: Column, pattern: str) -> Column:
    """A measure as a word: the share of characters that match, by powers of two."""
    n = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return F.concat(F.lit(f"#{name}"), F.floor(F.log2((n + 1) / (F.length(text) + 100))).cast("string"))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, the number of words, and the words with the measures."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, text.alias("_t")).select(
        *keep, _words(F.lower("_t")).alias("_w"),
        F.array(_share("symbols", F.col("_t"), r"[#*$%&|<>]+"), _share("capitals", F.col("_t"), r"[A-Z]+")).alias("_m"),
    ).select(*keep, F.size("_w").cast("long").alias("n_tokens"), F.concat("_w", "_m").alias("words"))


def learn(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS) -> tuple[list[str], list[list[float]], list[float]]:
    """Feature words, their log odds by domain, and the constant of each domain."""
    names = list(domains)
    domain = F.coalesce(*[F.when(F.expr(sql), F.lit(n)) for n, sql in domains.items()])
    merged = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain.alias("domain")).where("domain IS NOT NULL"))
    sizes = {r["domain"]: r["count"] for r in merged.groupBy("domain").count().collect()}
    if not sizes:
        return [], [], [0.0] + [-50.0] * (len(names) - 1)
    taken = F.lit(False)
    for name, n in sizes.items():
        taken = F.when(F.col("domain") == name, sampled(F.col("doc_id"), n, SAMPLE)).otherwise(taken)
    # About SAMPLE ids a domain, whatever the size of the corpus, and one text an id (the least one).
    chosen = F.broadcast(merged.where(taken))
    texts = cut(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")))
    some = tokens(texts, "domain")
    counted = cut(some.select("domain", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("domain") == n).alias(f"n_{n}") for n in names]))
    rows = some.groupBy("domain").count().collect()
    size = {n: 0 for n in names} | {r["domain"]: r["count"] for r in rows}
    total, z = sum(size.values()), []
    both = sum((F.col(f"n_{n}") for n in names), F.lit(0))
    for n in names:
        # Words that speak for a smaller domain: those of the largest one mostly tell languages apart.
        if 0 < size[n] < total and n != max(names, key=lambda k: sizes.get(k, 0)):
            spread = F.sqrt(both / total * (1 / size[n] + 1 / (total - size[n])))
            z.append((F.col(f"n_{n}") / size[n] - (both - F.col(f"n_{n}")) / (total - size[n])) / spread)
    prior = [math.log((sizes.get(n, 0) + 0.5) / (sum(sizes.values()) + 0.5 * len(names))) for n in names]
    if not z:
        return [], [], prior
    best = counted.where(both >= 5).select("*", (F.greatest(*z) if len(z) > 1 else z[0]).alias("z")).orderBy(F.desc("z"), "word").limit(FEATURES).collect()
    words = [r["word"] for r in best]
    share = [[(r[f"n_{n}"] + 0.5) / (size[n] + 1.0) for r in best] for n in names]
    # Absent words tell too: their part is in the constant, and taken back where the word is present.
    base = [p + sum(math.log(1 - x) for x in row) for p, row in zip(prior, share, strict=True)]
    return words, [[math.log(x / (1 - x)) for x in row] for row in share], base


def posteriors(docs: DataFrame, model: tuple, domains: dict[str, str] = DOMAINS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_tokens and p, the posterior by domain, of every row."""
    words, weights, prior = model
    known = F.array(*map(F.lit, words)).cast("array<string>")
    have = tokens(docs, *keep).select(*keep, "n_tokens", F.array_intersect("words", known).alias("have"))
    number = F.transform("have", lambda w: F.array_position(known, w).cast("int"))
    logs = have.select(*keep, "n_tokens", number.alias("at")).select(*keep, "n_tokens", *[
        F.aggregate("at", F.lit(float(p)), (lambda row: lambda acc, i: acc + F.element_at(row, i))(F.array(*map(F.lit, w)) if w else F.array().cast("array<double>"))).alias(f"_l{k}")
        for k, (p, w) in enumerate(zip(prior, weights or [[]] * len(prior), strict=True))])
    most = F.greatest(*[F.col(f"_l{k}") for k in range(len(prior))])
    e = F.transform(F.array(*[F.col(f"_l{k}") - most for k in range(len(prior))]), lambda x: F.exp(F.greatest(x, F.lit(-50.0))))
    p = let(e, lambda v: F.transform(v, lambda x: F.round(x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y), 6)))
    return logs.select(*keep, "n_tokens", p.alias("p"))


def rate(s: list[float]) -> Column:
    return F.greatest(F.lit(0.0), 1 - sum((F.get("p", F.lit(k)) * v for k, v in enumerate(s)), F.lit(0.0)))


def fit(members: DataFrame, targets: list[float]) -> list[float]:
    """S of the rates, by the projected gradient with two-point step lengths.

    Raises if STEPS end it further than MAX_RESIDUAL from the optimum.
    """
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    s = [0.0] * len(targets)
    if not total:
        return s
    before: tuple[list[float], list[float]] | None = None
    step, off = 1 / (1 + MU), math.inf
    for _ in range(STEPS):
        row = members.agg(*[F.sum(F.col("n_tokens") / total * F.get("p", F.lit(k)) * rate(s)).alias(f"a{k}") for k in range(len(targets))]).first()
        slope = [row[k] - t - MU * v for k, (t, v) in enumerate(zip(targets, s, strict=True))]
        off = max(map(abs, slope))
        if off < TOLERANCE:
            break
        if before:
            ds, dg = [a - b for a, b in zip(s, before[0], strict=True)], [b - a for a, b in zip(slope, before[1], strict=True)]
            turn = sum(a * b for a, b in zip(ds, dg, strict=True))
            step = min(max(sum(a * a for a in ds) / turn, 1 / (1 + MU)), 1 / MU) if turn > 0 else 1 / (1 + MU)
        before = (s, slope)
        s = [v + step * g for v, g in zip(s, slope, strict=True)]
    if off > MAX_RESIDUAL:
        raise RuntimeError(f"the rates are {off:.1e} from their optimum after {STEPS} steps")
    return s


def mix_sources(docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_tokens, the posterior of each domain, the rate, and whole copies drawn by it.

    A rate of 1.3 is one copy, and a second one for three of ten documents, by a hash of the columns keep.
    """
    members = cut(posteriors(docs, learn(docs, labels, domains), domains, keep))
    s = fit(members, [targets[n] for n in domains])
    drawn = F.pmod(F.xxhash64(*keep), F.lit(1_000_000)) / 1_000_000
    r = F.round(rate(s), 6)
    return members.select(*keep, "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{n}") for k, n in enumerate(domains)], r.alias("rate"),
                          (F.floor(r) + (drawn < r - F.floor(r)).cast("int")).cast("long").alias("n_copies"))
