"""Language identification by mixture inference.

Letter n-grams (1 to 4, with word boundaries, hashed) give each word a likelihood under
each language. For every document, expectation-maximisation over its words estimates the
proportions of the languages; the set of languages grows, best first, while the
penalised likelihood (BIC) improves. The prediction is the largest proportion.

Models are counted where the rows are, from a bounded sample of labelled ones: at most
``PER_LANGUAGE`` rows of each language (lowest id hashes first) of at most ``MAX_TRAIN_CHARS``
characters. All languages are learned and tried; over ``LANGUAGES`` of them are an error.
Inference takes whole texts of all rows.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is
every text when there is nothing to learn from; ties go to the language first in the
alphabet; repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm.common import bernoulli_fold

PER_LANGUAGE, LANGUAGES, MAX_TRAIN_CHARS = 1_500, 500, 40_000
BUCKETS = 1 << 16
REMEMBERED = 200_000


def _no_letters() -> str:
    """The word characters that are no letters (digits of all kinds, fractions, circled numbers), as ranges of a pattern."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()]
    starts = [c for k, c in enumerate(odd) if not k or odd[k - 1] != c - 1]
    ends = [c for k, c in enumerate(odd) if k + 1 == len(odd) or odd[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


#: Runs of letters.
WORD = re.compile(rf"[^\W_{_no_letters()}]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): hashed n-grams of 1 to 4 characters, a row of four for each character of the words between
    boundaries, and where each word begins. BUCKETS stands for n-grams that would leave their word."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(m) for m in marked])
    end = np.repeat(np.cumsum(size), size)
    ids = np.full((len(code), 4), BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint64)
    at = np.arange(len(code))
    for n in range(4):
        shifted = np.zeros(len(code), np.uint64)
        shifted[: len(code) - n] = code[n:]
        h = (h ^ (shifted + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        inside = at + n < end
        ids[inside, n] = ((h[inside] >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
    return ids, np.cumsum(size) - size


@dataclass
class LanguageModel:
    languages: list[str]
    loglik: np.ndarray  # (BUCKETS + 1, languages); zeros in the last row


def gram_counts(texts: Iterable[str | None]) -> np.ndarray:
    """How often each bucket's n-grams occur."""
    seen: dict[str, int] = {}
    for t in texts:
        for w in words_of(t):
            seen[w] = seen.get(w, 0) + 1
    counts, listed = np.zeros(BUCKETS, np.int64), list(seen)
    for s in range(0, len(listed), 20_000):
        part = listed[s : s + 20_000]
        ids, starts = grams(part)
        times = np.repeat([seen[w] for w in part], np.diff(np.append(starts, len(ids))))
        counts += np.bincount(ids.ravel(), np.repeat(times, 4), BUCKETS + 1)[:BUCKETS].astype(np.int64)
    return counts


def model_of(counts: dict[str, np.ndarray]) -> LanguageModel | None:
    names = sorted(counts)
    if not names:
        return None
    table = np.stack([counts[x] for x in names], axis=1).astype(float)
    smooth = table + 0.5 * (table.sum(axis=1, keepdims=True) / len(names) + 1) / np.maximum(table.sum(axis=0), 1)
    return LanguageModel(names, np.vstack([np.log(smooth / smooth.sum(axis=0)), np.zeros(len(names))]))


def fit(docs: DataFrame, fold: int = 0, parts: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """The driver gets one row of BUCKETS counts for each language, and no text."""
    usable = docs.where(F.col(lang_col).isNotNull() & (bernoulli_fold(F.col(id_col), parts) != fold) & (F.length(text_col) <= MAX_TRAIN_CHARS))
    rows = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang_col} has over {LANGUAGES} values")
    if not sizes:
        return None
    # twice the share that is wanted passes by hash alone, map-side; only those rows are ranked
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 2 * PER_LANGUAGE / n))])
    likely = rows.where(F.col("_h").cast("double") <= (F.element_at(share, F.col("_lang")) * 2 - 1) * float(1 << 63))
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = likely.dropDuplicates(["_lang", "_id"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PER_LANGUAGE).select("_id", "_lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str | None]] = {}
            for t, name in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                total[name] = total.get(name, 0) + gram_counts(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["_lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"_lang": table.column("_lang").slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    texts = usable.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    # at most PER_LANGUAGE * LANGUAGES ids; of rows that repeat one, the first in order of the text counts
    picked = texts.join(F.broadcast(chosen), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    kind = "_lang string, counts binary"
    got = picked.select("_text", "_lang").mapInArrow(count, kind).groupBy("_lang").applyInArrow(add, kind).collect()
    return model_of({r["_lang"]: np.frombuffer(r["counts"], np.int64) for r in got})


def mixture(ll: np.ndarray, languages: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """EM for the proportions of ``languages`` over words with log-likelihoods ``ll``; (proportions, log-likelihood)."""
    own = ll[:, languages]
    top = own.max(axis=1)
    like = np.exp(own - top[:, None])
    pi = np.full(len(languages), 1 / len(languages))
    n = len(ll)
    for _ in range(rounds):
        new = pi * (like.T @ (1 / (like @ pi))) / n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(np.log(like @ pi).sum() + top.sum())


def infer(ll: np.ndarray) -> np.ndarray:
    """Proportions of all languages for one document's words."""
    n, m = ll.shape
    totals = ll.sum(axis=0)
    best = int(np.argmax(totals))
    out = np.zeros(m)
    if m == 1:
        out[0] = 1
        return out
    # every language's share if each word went to its own best: the order in which languages are tried
    order = np.argsort(-np.bincount(ll.argmax(axis=1), minlength=m), kind="stable")
    chosen, pi, gain = [best], np.ones(1), float(totals[best])
    penalty = 0.5 * np.log(n) + 2
    for k in [int(x) for x in order if x != best]:
        tried = np.array([*chosen, k])
        p, loglik = mixture(ll, tried)
        if loglik - gain <= penalty:
            break
        chosen, pi, gain = list(tried), p, loglik
    out[chosen] = pi
    return out


def predictor(model: LanguageModel | None):
    if model is None:
        return lambda texts: [(UNDETERMINED, 0.0)] * len(texts)
    m = len(model.languages)
    ids: dict[str, int] = {}
    rows = np.zeros((REMEMBERED, m))

    def lookup(words: list[str]) -> np.ndarray:
        out = np.empty((len(words), m))
        step = REMEMBERED // 4
        for s in range(0, len(words), step):
            part = words[s : s + step]
            if len(ids) + len(part) > REMEMBERED:
                ids.clear()
            new = [w for w in dict.fromkeys(part) if w not in ids]
            if new:
                own, starts = grams(new)
                first = len(ids)
                rows[first : first + len(new)] = np.add.reduceat(model.loglik[own].sum(axis=1), starts, axis=0)
                ids.update(zip(new, range(first, first + len(new)), strict=True))
            out[s : s + step] = rows[np.fromiter(map(ids.__getitem__, part), np.int64, len(part))]
        return out

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            words = words_of(t)
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            pi = infer(lookup(words))
            k = int(np.argmax(pi))
            out.append((model.languages[k], float(min(1.0, pi[k]))))
        return out

    return predict


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the predicted language's proportion)."""
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # a few MB, whatever the input
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value and LanguageModel(**shared.value))
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                found = predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
