"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hash, its first four and its first six
characters. Filters of widths 1, 2 and 3 run over the whole text; each keeps its
maximum, and a logistic layer scores the maxima. Training draws a bounded sample of
labelled rows (``MAX_POSITIVE`` + ``MAX_NEGATIVE``, lowest hashes of the id first, texts
of at most ``MAX_TRAIN_CHARS`` characters, ``MAX_TRAIN_TOTAL`` together) to the driver;
everything else runs on all rows.

A validation fifth of the sample sets the score's scale, so that the best cut lies at
0.3, and a threshold for each language: its own best cut, drawn towards the common one the
more, the fewer positives it has (``PULL`` of them count as much as the common cut). Language
decides only which threshold applies; it never enters a score.

Defined results: null and empty texts get the score of an empty text; any length is
scored whole; repeated rows are each scored; rows without a label or with a label other
than 0 and 1 train nothing; with no usable labels every score is 0; extra columns are
carried or ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm.common import bernoulli_fold

MAX_POSITIVE, MAX_NEGATIVE, MAX_TRAIN_CHARS, MAX_TRAIN_TOTAL = 3_000, 5_000, 60_000, 80_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
CUT, PULL = 0.3, 20
#: Distinct words that a worker remembers.
REMEMBERED = 150_000
WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> tuple[int, int, int]:
    raw = word.encode("utf-8", "surrogatepass")
    return tuple(zlib.crc32(tag + part) % BUCKETS for tag, part in ((b"w", raw), (b"4", word[:4].encode("utf-8", "surrogatepass")), (b"6", word[:6].encode("utf-8", "surrogatepass"))))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class ToxicityModel:
    embed: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) for each width
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    cut: float = 0.5  # the probability that is shown as CUT
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, maxima: np.ndarray) -> np.ndarray:
        z = np.clip(np.maximum(maxima + self.bias, 0) @ self.dense + self.offset, -30, 30)
        return 1 / (1 + np.exp(-z))

    def scaled(self, p: np.ndarray) -> np.ndarray:
        c = self.cut
        return np.where(p < c, p / c * CUT, CUT + (p - c) / (1 - c) * (1 - CUT))

    def projections(self) -> np.ndarray:
        """(BUCKETS, sum of widths * FILTERS): each bucket's share in each tap of each filter."""
        taps = np.concatenate([w[k] for w in self.filters for k in range(w.shape[0])], axis=1)
        return (self.embed @ taps).astype(np.float32)


def _untrained(rng: np.random.Generator) -> ToxicityModel:
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return ToxicityModel(embed, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, 3) with -1 pads after each document, the start of each document, and its number of positions."""
    n = np.array([max(len(d), 1) for d in docs])
    starts = np.concatenate([[0], np.cumsum(n + max(WIDTHS) - 1)[:-1]])
    out = np.full((int((n + max(WIDTHS) - 1).sum()), 3), -1, np.int64)
    for s, d in zip(starts, docs, strict=True):
        out[s : s + len(d)] = d
    return out, starts, n


def _forward(m: ToxicityModel, feats: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima (docs, filters) and the positions they come from."""
    padded = np.vstack([m.embed, np.zeros((1, DIM), np.float32)])
    x = padded[feats[:, 0]] + padded[feats[:, 1]] + padded[feats[:, 2]]
    inside = np.zeros(len(feats), bool)
    for s, k in zip(starts, n, strict=True):
        inside[s : s + k] = True
    maxima, places = [], []
    for w in m.filters:
        y = np.zeros((len(x), FILTERS), np.float32)
        for k in range(w.shape[0]):
            y[: len(x) - k] += x[k:] @ w[k]
        y[~inside] = -np.inf
        best = np.maximum.reduceat(y, starts, axis=0)
        where = np.stack([s + y[s : s + k].argmax(axis=0) for s, k in zip(starts, n, strict=True)])
        maxima.append(best)
        places.append(where)
    return np.concatenate(maxima, axis=1), np.concatenate(places, axis=1)


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.t += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.99**self.t)) + 1e-6)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 14, batch: int = 48, seed: int = 7) -> ToxicityModel:
    """``docs``: word features (n, 3) each. Only the positions of the maxima carry gradients."""
    rng = np.random.default_rng(seed)
    m = _untrained(rng)
    tune = {"embed": _Adam(m.embed.shape, 0.02), "bias": _Adam(m.bias.shape, 0.01), "dense": _Adam(m.dense.shape, 0.02), "offset": _Adam((1,), 0.02)}
    tune_filters = [_Adam(w.shape, 0.01) for w in m.filters]
    positive = max(1.0, min(4.0, float((labels == 0).sum() / max(1, (labels == 1).sum())) ** 0.5))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), batch):
            own = order[b : b + batch]
            feats, starts, n = _flat([docs[i] for i in own])
            maxima, places = _forward(m, feats, starts, n)
            hidden = np.maximum(maxima + m.bias, 0)
            keep = (rng.random(hidden.shape) > 0.2) / 0.8
            z = np.clip((hidden * keep) @ m.dense + m.offset, -30, 30)
            y = labels[own]
            dz = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, positive, 1.0) / len(own)
            dhidden = (dz[:, None] * m.dense[None, :]) * keep * (maxima + m.bias > 0)
            rows, grads = [], []
            padded = np.vstack([m.embed, np.zeros((1, DIM), np.float32)])
            for j, w in enumerate(m.filters):
                g = dhidden[:, j * FILTERS : (j + 1) * FILTERS]
                at = places[:, j * FILTERS : (j + 1) * FILTERS]
                dw = np.zeros_like(w)
                for k in range(w.shape[0]):
                    f = feats[np.minimum(at + k, len(feats) - 1)]  # (docs, filters, 3)
                    x = padded[f].sum(axis=2)  # (docs, filters, dim)
                    dw[k] = np.einsum("df,dfe->ef", g, x)
                    dx = g[:, :, None] * w[k].T[None, :, :]
                    for c in range(3):
                        ok = f[:, :, c] >= 0
                        rows.append(f[:, :, c][ok])
                        grads.append(dx[ok])
                tune_filters[j].step(w, dw + 1e-4 * w)
            ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            tune["embed"].step(m.embed, total, ids)
            offset = np.array([m.offset], np.float32)
            tune["offset"].step(offset, np.array([dz.sum()], np.float32))
            m.offset = float(offset[0])
            tune["dense"].step(m.dense, ((hidden * keep).T @ dz + 1e-4 * m.dense).astype(np.float32))
            tune["bias"].step(m.bias, dhidden.sum(axis=0).astype(np.float32))
    return m


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap where F1 is best; 0.5 without both classes."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(p[:-1] != p[1:], True)  # a cut lies between different scores
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.02, 0.98))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 2, parts: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list:
    """The bounded sample: labelled rows outside the held-out fold, lowest id hashes first."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (bernoulli_fold(F.col(id_col), parts) != fold)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    mixed = F.xxhash64(F.col("_id").cast("string"))
    few = [usable.where(F.col("_y") == y).orderBy(mixed, "_id").limit(k) for y, k in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    chosen = few[0].unionByName(few[1])  # at most MAX_POSITIVE + MAX_NEGATIVE rows
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.length(text_col) <= MAX_TRAIN_CHARS).select(F.col(id_col).alias("_id"), F.struct(F.col(text_col).alias("t"), lang.alias("l")).alias("x"))
    once = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("x").alias("x"))  # of rows that repeat an id, one
    upto = F.sum(F.length("x.t")).over(Window.orderBy(mixed, "_id").rowsBetween(Window.unboundedPreceding, 0))  # over the chosen rows, not the table
    found = once.withColumn("upto", upto).where(F.col("upto") <= MAX_TRAIN_TOTAL).select("_id", F.col("x.t").alias("__lx_text"), F.col("x.l").alias("_lang"), "_y").collect()
    return sorted(found, key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["__lx_text"]))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 2, parts: int = 4, **columns) -> ToxicityModel | None:
    rows = training_rows(docs, labels, fold, parts, **columns)
    y = np.array([r["_y"] for r in rows])
    if not len(rows) or not (y == 1).any() or not (y == 0).any():
        return None
    cache: dict[str, tuple[int, int, int]] = {}
    feats = []
    for r in rows:
        w = words_of(r["__lx_text"])
        for x in w:
            if x not in cache:
                cache[x] = word_features(x)
        feats.append(np.array([cache[x] for x in w], np.int32).reshape(-1, 3))
    held = np.arange(len(rows)) % 5 == 0
    inner = train([f for f, h in zip(feats, held, strict=True) if not h], y[~held])
    val = [f for f, h in zip(feats, held, strict=True) if h]
    p = np.concatenate([inner.probability(_forward(inner, *_flat(val[i : i + 64]))[0]) for i in range(0, len(val), 64)])
    inner.cut = best_cut(p, y[held])
    scores = inner.scaled(p)
    langs = np.array([r["_lang"] or "" for r, h in zip(rows, held, strict=True) if h])
    for name in sorted(set(langs.tolist())):
        own = langs == name
        k = int(y[held][own].sum())
        inner.thresholds[name] = round(float((k * best_cut(scores[own], y[held][own]) + PULL * CUT) / (k + PULL)), 4)
    return inner


def scorer(model: ToxicityModel | None):
    """A function of a list of texts; keeps the projections of the words it has met."""
    if model is None:
        return lambda texts: np.zeros(len(texts))
    table = np.vstack([model.projections(), np.zeros((1, sum(WIDTHS) * FILTERS), np.float32)])
    ids: dict[str, int] = {}
    rows = np.zeros((REMEMBERED + 1, table.shape[1]), np.float32)  # row 0: padding

    def lookup(words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = ids.get(w)
            if k is None:
                k = ids[w] = len(ids) + 1
                rows[k] = table[list(word_features(w))].sum(axis=0)
            out[i] = k
        return out

    def maxima(words: list[str]) -> np.ndarray:
        best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        step = 20_000  # positions at a time, with the words that the widest filter needs after them
        for s in range(0, max(len(words), 1), step):
            part = words[s : s + step + max(WIDTHS) - 1]
            if len(ids) + len(part) > REMEMBERED:
                ids.clear()
            here = min(step, max(len(words) - s, 1))
            k = np.concatenate([lookup(part), np.zeros(max(0, here + max(WIDTHS) - 1 - len(part)), np.int64)])
            col = 0
            for j, w in enumerate(WIDTHS):
                y = rows[k[:here], col : col + FILTERS]
                for t in range(1, w):
                    y = y + rows[k[t : t + here], col + t * FILTERS : col + (t + 1) * FILTERS]
                col += w * FILTERS
                at = slice(j * FILTERS, (j + 1) * FILTERS)
                best[at] = np.maximum(best[at], y.max(axis=0))
        return best

    def score(texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.clip(model.scaled(model.probability(np.stack([maxima(words_of(t)) for t in texts]))), 0.0, 1.0)

    return score


def score_documents(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` added; an existing column of that name is replaced."""
    keep = [c for c in (keep or docs.columns) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # a few MB, whatever the input
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value and ToxicityModel(**shared.value))
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                values = score(part.column("__lx_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(values, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias("__lx_text")).mapInArrow(run, schema)


def threshold_of(model: ToxicityModel | None, lang_col: str = "lang"):
    """The calibrated threshold of the row's language, else the common one."""
    own = model.thresholds if model else {}
    if not own:
        return F.lit(CUT)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.coalesce(F.col(lang_col), F.lit(""))), F.lit(CUT))
