"""Suffix-array dedup: bytes under a 200-byte string that starts anywhere else go.

A suffix array of the whole corpus would be one sort of all its bytes, so windows first
meet where they can be equal. Every 200-byte window elects an anchor, the leftmost of its
24-byte grams with the smallest hash; equal windows elect equal anchors. Neighbouring
windows share an anchor, so a text falls into runs of windows, one anchor each. Runs whose
anchor occurs once in the corpus are done. The others send the bytes that their windows
span to their anchor's bucket; there a suffix array by two-stage sorting (``suffix_array``)
orders all suffixes, and adjacent common prefixes of 200 bytes mark the repeated windows.

Texts that are equal as a whole are one text with a count; equal spans are one entry with a
count. An anchor with over ``HOT`` different spans is settled by exact window digests in an
ordinary aggregation instead of one task's suffix array.

Defined results: a null text is empty; texts under 200 bytes lose nothing; repeated rows are
equal texts, so both lose all (from 200 bytes on); texts of any length are used whole, in
overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_ROWS, staged
from lintel.llm.suffix_array import common_prefixes, two_stage

LENGTH, GRAM = 200, 24
#: Bytes handled at once, and the most different spans of one anchor that go to one task.
PIECE, HOT = 1 << 20, 20_000
#: About so many bytes of spans are sorted at once.
BUCKET_BYTES = 3_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string of ``data``."""
    base, step, h = _BASE, 1, data.astype(np.uint64) + np.uint64(1)
    kept = {}
    with np.errstate(over="ignore"):
        while step < GRAM:
            kept[step] = (h, base)
            if 2 * step > GRAM:
                break
            h = h[:-step] * base + h[step:]
            base, step = base * base, 2 * step
        # 16 bytes and the 8 after them
        h16, h8 = kept[16][0], kept[8][0]
        h = h16[: len(data) - GRAM + 1] * kept[8][1] + h8[16 : 16 + len(data) - GRAM + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def elected(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LENGTH-byte window of ``data``, of at most 16 MB: the position of its anchor; and all gram hashes."""
    h = gram_hashes(data)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    return (key & np.uint64(0xFFFFFF)).astype(np.int64), h


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, first window, last window, anchor hash) of every run of windows, piece by piece."""
    batch: list[tuple[int, int, bytes]] = []
    held = 0

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        sizes = np.array([len(x) for _, _, x in batch])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        anchor, h = elected(data)
        owner = np.repeat(np.arange(len(batch)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) + LENGTH <= (begin + sizes)[owner]
        at = np.flatnonzero(valid)
        if not len(at):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        first = np.append(True, (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]))
        lo = at[first]
        hi = np.append(at[np.flatnonzero(first)[1:] - 1], at[-1])
        own = owner[lo]
        offset = np.array([o for _, o, _ in batch])[own] - begin[own]
        return np.array([i for i, _, _ in batch])[own], lo + offset, hi + offset, h[anchor[lo]].view(np.int64)

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for s in range(0, len(text) - LENGTH + 1, PIECE):
            part = text[s : s + PIECE + LENGTH - 1]
            batch.append((i, s, part))
            held += len(part)
            if held >= PIECE:
                yield settle()
                batch, held = [], 0
    if batch:
        yield settle()


def _bytes(part: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in part.column(name).to_pylist()]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def named_by(sha: Column) -> Column:
    """The first 64 bits of a digest in hex, as a number."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("bigint")


def _runs(texts: DataFrame) -> DataFrame:
    """(h, name, lo) for each run of windows of each text; ``name`` is 64 bits of the text's digest, as in ``named_by``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            data = _bytes(part, "_text")
            names = np.array([int.from_bytes(sha256(x).digest()[:8], "big", signed=True) for x in data], np.int64)
            for own, lo, _, h in runs_of(data):
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(names[own], pa.int64()), pa.array(lo, pa.int64())], names=["h", "name", "lo"])

    return texts.mapInArrow(run, "h bigint, name bigint, lo bigint")


def _spans(texts: DataFrame) -> DataFrame:
    """(h, dig, cls, lo, span) for the runs whose first windows are listed in ``los``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 256):
            data, cls = _bytes(part, "_text"), part.column("cls").to_pylist()
            wanted = [set(x) for x in part.column("los").to_pylist()]
            for own, lo, hi, h in runs_of(data):
                rows = [(int(h[k]), cls[i], a, data[i][a : int(hi[k]) + LENGTH]) for k, (i, a) in enumerate(zip(own.tolist(), lo.tolist(), strict=True)) if a in wanted[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([blake2b(r[3], digest_size=16).digest() for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                    names=["h", "dig", "cls", "lo", "span"],
                )

    return texts.mapInArrow(run, "h bigint, dig binary, cls binary, lo bigint, span binary")


def repeated_windows(spans: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each span the sorted offsets of its windows that occur elsewhere among the spans or in an equal span."""
    sizes = np.array([len(s) + 1 for s in spans])
    text = np.frombuffer(b"".join(s + b"\xff" for s in spans), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(spans)), sizes)
    whole = np.arange(len(text)) + LENGTH < (begin + sizes)[owner]  # a window that ends within its span
    order, keys = two_stage(text, LENGTH)
    order = order[whole[order]]
    same = common_prefixes(order, keys, LENGTH) >= LENGTH
    marked = whole & (np.array(counts) > 1)[owner]
    marked[order[:-1][same]] = True
    marked[order[1:][same]] = True
    at = np.flatnonzero(marked)
    cuts = np.searchsorted(at, np.append(begin, len(text)))
    return [at[cuts[k] : cuts[k + 1]] - begin[k] for k in range(len(spans))]


def _covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """The union of the windows at sorted ``starts``, as intervals."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + LENGTH).tolist(), strict=True))


def _sorted_bucket(table: pa.Table) -> pa.Table:
    out = []
    rows = list(zip(*(table.column(x).to_pylist() for x in ("h", "dig", "span", "n")), strict=True))
    rows.sort(key=lambda r: r[0])  # an anchor's spans lie together
    at = 0
    while at < len(rows):
        end, held = at, 0
        while end < len(rows) and (held < BUCKET_BYTES or rows[end][0] == rows[end - 1][0]):
            held += len(rows[end][2])
            end += 1
        part = rows[at:end]
        for r, starts in zip(part, repeated_windows([r[2] for r in part], [r[3] for r in part]), strict=True):
            out += [(r[0], r[1], s, e) for s, e in _covered(starts)]
        at = end
    return pa.table({"h": pa.array([r[0] for r in out], pa.int64()), "dig": pa.array([r[1] for r in out], pa.binary()), "s": pa.array([r[2] for r in out], pa.int64()), "e": pa.array([r[3] for r in out], pa.int64())})


def _hot_windows(spans: DataFrame) -> DataFrame:
    """(h, dig, s, e) of repeated windows of anchors with very many spans, by the windows' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 64):
            rows = [(h, d, a, n, sha256(x[a : a + LENGTH]).digest()) for h, d, x, n in zip(*(part.column(c).to_pylist() for c in ("h", "dig", "span", "n")), strict=True) for a in range(len(x) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())], names=["h", "dig", "s", "n", "w"])

    windows = spans.mapInArrow(run, "h bigint, dig binary, s bigint, n bigint, w binary")
    windows = staged(windows)
    often = windows.groupBy("w").agg(F.sum("n").alias("all")).where("all > 1").select("w")
    return windows.join(often, "w", "left_semi").select("h", "dig", "s", (F.col("s") + LENGTH).alias("e"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(_id, n_bytes, sha, cls)``, ``texts(cls, _text)`` of candidates, ``found(cls, s, e)``: removable intervals,
    neither merged nor sorted; wholly repeated texts are to be seen from ``rows`` alone."""
    raw = docs.select(F.col(id_col).alias("_id"), _raw(text_col).alias("_text"))
    rows = staged(raw.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("sha")))
    rows = rows.withColumns({"cls": F.substring(F.unhex("sha"), 1, 16), "name": named_by(F.col("sha"))})
    by_anchor, place = Window.partitionBy("h"), F.xxhash64("name", "lo")
    # a grouped minimum and a join instead of the window would leave no hot anchor, at an eighth more CPU time
    runs = _runs(raw.select("_text")).withColumns({"a": F.min(place).over(by_anchor), "b": F.max(place).over(by_anchor)})
    wanted = staged(runs.where("a <> b").groupBy("name").agg(F.collect_set("lo").alias("los")))
    holders = staged(rows.where(F.col("n_bytes") >= LENGTH).groupBy("cls", "name").agg(F.min("_id").alias("rep")).join(wanted.select("name"), "name", "left_semi"))
    ids = F.broadcast(holders) if holders.count() <= BROADCAST_ROWS else holders
    named = raw.join(ids, raw["_id"].eqNullSafe(ids["rep"])).where(F.substring(F.unhex(F.sha2("_text", 256)), 1, 16) == F.col("cls"))
    texts = staged(named.select("cls", "name", "_text").dropDuplicates(["cls"]))
    # texts of one name, should there be two, look at each other's runs too, which changes nothing in the end
    spans = staged(_spans(texts.join(wanted, "name")))
    once = spans.groupBy("h", "dig").agg(F.first("span").alias("span"), F.count("*").alias("n"))
    hot = staged(spans.select("h", "dig").distinct().groupBy("h").count().where(F.col("count") > HOT).select("h"))
    total = spans.agg(F.sum(F.octet_length("span"))).first()[0] or 0
    buckets = max(1, int(total // BUCKET_BYTES))
    cool = once.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "h", "left_anti")
    sorted_ = cool.withColumn("k", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("k").applyInArrow(_sorted_bucket, "h bigint, dig binary, s bigint, e bigint")
    windows = _hot_windows(once.join(hot, "h", "left_semi"))
    marked = sorted_.unionByName(windows)
    found = spans.select("h", "dig", "cls", "lo").join(marked, ["h", "dig"]).select("cls", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    return rows.drop("name"), texts.drop("name"), found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (array of s, e), kept (the bytes left; null where all
    or none are removed), kept_sha256."""
    rows, texts, found = repeated_spans(docs, id_col, text_col)
    listed = found.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 512):
            out = []
            for c, text, raw in zip(part.column("cls").to_pylist(), _bytes(part, "_text"), part.column("raw").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in raw:
                    if spans and x["s"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["e"])
                    else:
                        spans.append([x["s"], x["e"]])
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(text)], strict=True))
                out.append({"cls": c, "spans": [{"s": s, "e": e} for s, e in spans], "kept": kept, "kept_sha256": sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cls", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())]))

    cuts = texts.join(listed, "cls").mapInArrow(cut, "cls binary, spans array<struct<s:bigint,e:bigint>>, kept binary, kept_sha256 string")
    copies = rows.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1")
    out = rows.join(cuts, "cls", "left").join(copies, "cls", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    out = out.withColumn("spans", F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "spans",
        F.when(~F.coalesce(whole, F.lit(False)), F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
