"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A classifier is fitted on the rows that the label table names: multinomial naive Bayes over
all words of their texts, hashed into ``BUCKETS``, from one grouped count. It gives every
document posteriors over the domains, which are all values of ``domain_col`` (by default
``lang``) that labelled rows hold. A text's evidence counts as that of at most ``EVIDENCE``
words, since words aren't independent, so memberships stay soft. Nonnegative rates r then solve

    min 1/2 sum_d ((sum_i r_i n_i p_id) / N - t_d)^2 / q_d + c/2 sum_i n_i (r_i - 1)^2 / N

with n words, N their sum, p posteriors, q the corpus's own shares and t the targets, by
projected gradient: an iteration is one aggregation (one number a domain comes back) and
``r <- max(0, r - step (sum_d g_d p_id / q_d + c (r - 1)))``, with the steps of Barzilai and
Borwein, never under that of the largest curvature, 1 + c. A rate is a function of the
posteriors and of the gradients so far, so rates are never stored or joined. Rounds end when
one more moves no domain's share by ``TOLERANCE``; ``MOST_ROUNDS`` without that is an error.

The default targets are the corpus's shares raised to ``FLATTEN`` and normalised. Targets
that name a domain which no labelled row holds are an error.

Defined results: a null or empty text has no words and the rate that the priors give; very
long texts are counted whole; rows with a null domain are mixed but train nothing; with no
labelled rows, or no words, every rate is 1; repeated rows get equal rates; an empty table
stays empty; further columns are kept, but ``n_tokens``, ``domain``, ``domain_weight`` and
``rate`` of the input are replaced; over ``DOMAINS`` domains are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_ROWS, alnum_words, staged

#: Hash buckets of words (they fit smallint), and the most domains: their product bounds the model that a task holds.
BUCKETS, DOMAINS = 1 << 14, 1_000
SMOOTH, EVIDENCE = 0.5, 60
FLATTEN, KEEP, MOST_ROUNDS, TOLERANCE = 0.7, 1e-3, 200, 1e-5
MADE = ["n_tokens", "domain", "domain_weight", "rate"]


@dataclass
class Mixture:
    domains: list[str]
    prior: list[float]
    weights: DataFrame  # one row, array<double>, the log-likelihood of bucket k under domain d at k * domains + d
    shares: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)  # of each round the gradient, already over the shares, and the step


def words(text: Column) -> Column:
    """Runs of what is no ASCII control, space or punctuation character, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def buckets(text: Column) -> Column:
    """The hash bucket of every word, in order."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("smallint"))


def memberships(docs: DataFrame, m: Mixture | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``__lx_n``, the words, and ``__lx_p``, array<double> of posteriors over
    ``m.domains``. Staged, so that the texts are read once, and no filter of a later step computes posteriors anew."""
    own = [c for c in (keep or docs.columns) if c not in MADE]
    seen = docs.select(*own, buckets(F.col(text_col)).alias("__lx_b"))
    n = F.size("__lx_b").cast("long").alias("__lx_n")
    if m is None:
        return staged(seen.select(*own, n, F.array().cast("array<double>").alias("__lx_p")))
    size = len(m.domains)
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda d: F.aggregate("__lx_b", F.lit(0.0), lambda a, b: a + F.get(F.col("__lx_w"), b.cast("int") * size + d)),
    )
    prior = F.array(*[F.lit(math.log(p)) for p in m.prior])
    weight = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("__lx_b"), F.lit(1)))
    # each step is used more than once in the next, so that it is a column of its own and computed once
    out = seen.withColumn("__lx_w", m.weights.scalar()).withColumn("__lx_l", F.zip_with(logs, prior, lambda x, p: x * weight + p))
    out = out.withColumn("__lx_m", F.array_max("__lx_l")).withColumn("__lx_e", F.transform("__lx_l", lambda v: F.exp(v - F.col("__lx_m"))))
    out = out.withColumn("__lx_t", F.aggregate("__lx_e", F.lit(0.0), lambda a, v: a + v))
    return staged(out.select(*own, n, F.transform("__lx_e", lambda v: v / F.col("__lx_t")).alias("__lx_p")))


def rates(m: Mixture, p: Column) -> Column:
    """The document's rate after all of the fit's rounds, and the one before (``now``, ``before``)."""
    rounds = F.lit(m.steps).cast("array<array<double>>") if m.steps else F.array().cast("array<array<double>>")

    def moved(state: Column, g: Column) -> Column:
        r = state["now"]
        pull = F.aggregate(F.zip_with(p, F.slice(g, 1, len(m.domains)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.struct(F.greatest(F.lit(0.0), r - F.get(g, F.lit(len(m.domains))) * (pull + KEEP * (r - 1))).alias("now"), r.alias("before"))

    return F.aggregate(rounds, F.struct(F.lit(1.0).alias("now"), F.lit(1.0).alias("before")), moved)


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang") -> Mixture | None:
    """The domains, their priors and word weights, from all rows that ``labels`` names; None where there are none."""
    named = staged(labels.select(F.col(id_col).alias("__lx_id")).where("__lx_id is not null").distinct())
    rows = docs.select(F.col(id_col).alias("__lx_id"), F.col(domain_col).cast("string").alias("d"), F.col(text_col).alias("b")).where("d is not null")
    if named.count() <= BROADCAST_ROWS:
        labelled = rows.join(F.broadcast(named), "__lx_id", "left_semi").withColumn("b", buckets(F.col("b")))
    else:  # buckets are shuffled, not texts
        labelled = rows.withColumn("b", buckets(F.col("b"))).join(named, "__lx_id", "left_semi")
    labelled = staged(labelled.drop("__lx_id"))
    sizes = labelled.groupBy("d").agg(F.count("*").alias("docs"), F.sum(F.size("b")).alias("words")).limit(DOMAINS + 1).collect()
    if len(sizes) > DOMAINS:
        raise ValueError(f"{domain_col} has over {DOMAINS} values among labelled rows")
    if not sizes:
        return None
    sizes.sort(key=lambda r: r["d"])
    domains, every = [r["d"] for r in sizes], sum(r["docs"] for r in sizes)
    number = lambda d: F.array_position(F.array(*[F.lit(x) for x in domains]), d) - 1
    counts = labelled.select("d", F.explode("b").alias("b")).groupBy("d", "b").agg(F.count("*").alias("n"))
    counts = counts.select((F.col("b").cast("long") * len(domains) + number(F.col("d"))).alias("id"), "n")
    total = F.get(F.array(*[F.lit(float(r["words"])) for r in sizes]), F.pmod("id", F.lit(len(domains))).cast("int"))
    cells = docs.sparkSession.range(BUCKETS * len(domains)).join(counts, "id", "left")
    value = F.log((F.coalesce("n", F.lit(0)) + SMOOTH) / (total + SMOOTH * BUCKETS))
    # BUCKETS * DOMAINS numbers at most, whatever the input
    weights = cells.select(F.struct("id", value.alias("w")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return Mixture(domains, [r["docs"] / every for r in sizes], staged(weights.select(F.transform("x", lambda x: x["w"]).alias("w"))))


def solve(placed: DataFrame, m: Mixture, targets: dict[str, float] | None = None) -> Mixture:
    """``m`` with the rounds that bring ``placed`` (of ``memberships``) to the targets."""
    if unknown := sorted(set(targets or {}) - set(m.domains)):
        raise ValueError(f"targets name domains that no labelled row holds: {', '.join(unknown)}")
    if targets is not None and not sum(targets.values()) > 0:
        raise ValueError("the targets' sum isn't positive")
    seen = placed.select(F.col("__lx_n").alias("n"), F.col("__lx_p").alias("p"))
    size = len(m.domains)

    def totals() -> tuple[float, float, list[float]]:
        """All words, the last round's squared moves, and the words that each domain holds now."""
        rated = seen.withColumn("r", rates(m, F.col("p")))
        held = [F.sum(F.col("n") * F.col("r.now") * F.col("p")[k]) for k in range(size)]
        got = rated.agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("r.now") - F.col("r.before"), 2.0)), *held).first()
        every, moves, *held = [float(x or 0) for x in got]
        return every, moves, held

    m.steps, step = [], 1 / (1 + KEEP)
    every, _, held = totals()
    if not every:
        return m
    m.shares = [max(x / every, 1e-9) for x in held]
    wanted = [targets.get(d, 0.0) for d in m.domains] if targets else [s**FLATTEN for s in m.shares]
    m.targets = [t / sum(wanted) for t in wanted]
    for _ in range(MOST_ROUNDS):
        before = held
        m.steps.append([*[(x / every - t) / s for x, t, s in zip(held, m.targets, m.shares, strict=True)], step])
        _, moves, held = totals()
        moved = [(x - y) / every for x, y in zip(held, before, strict=True)]
        if max(map(abs, moved)) <= TOLERANCE:
            return m
        curved = sum(x * x / s for x, s in zip(moved, m.shares, strict=True)) + KEEP * moves / every
        step = max(1 / (1 + KEEP), moves / every / curved)
    raise RuntimeError(f"the rates did not converge in {MOST_ROUNDS} rounds")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens (words), domain (the likeliest), domain_weight (its posterior) and rate."""
    m = classifier(docs, labels, id_col, text_col, domain_col)
    placed = memberships(docs, m, text_col, keep)
    own = [c for c in placed.columns if c not in ("__lx_n", "__lx_p")]
    n = F.col("__lx_n").alias("n_tokens")
    if m is None:
        return placed.select(*own, n, F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("domain_weight"), F.lit(1.0).alias("rate"))
    m = solve(placed, m, targets)
    best = F.array_max("__lx_p")
    named = F.element_at(F.array(*[F.lit(d) for d in m.domains]), F.array_position("__lx_p", best).cast("int"))
    return placed.select(*own, n, named.alias("domain"), best.alias("domain_weight"), rates(m, F.col("__lx_p"))["now"].alias("rate"))
