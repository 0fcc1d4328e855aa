"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact, without pairs of whole groups.

A document is its set of distinct five-word shingles, as 64-bit hashes. The steps:

1. Equal sets form classes; one text of each class goes on.
2. Two sets of similarity 0.8 share at least 0.8 of either, so at most ``n - ceil(0.8 n)``
   shingles of a class that has a partner occur nowhere else. One half of the hash range is
   enough to see that bound broken by any text of its own. That half's shingles travel packed
   (32 bits within a slice of the range, classes named once a batch; what several classes of a
   batch share travels once) to be counted; classes over the bound leave. Collisions and
   classes met in several batches only let more classes stay. Sets and packed shingles come
   from one reading of the texts, what stays from a second one.
3. The rest order their shingles by rarity (a fixed-size count sketch over all of them) and
   post their prefix ``n - ceil(0.8 n) + 1``, apart by bands of set size that linked sets are
   at most one apart in. Linked classes share a posted shingle, so stars over each inverted
   list, then components, give families closed under links.
4. In a family every class queries the others for its T-occurrence: L long inverted lists
   are set aside, the short ones are merged, and those that reach ``T - L`` are probed in
   the long lists by binary search. The counts are exact overlaps; all of them are compared
   with the threshold. Small families share a task; one over ``BLOCK_TOKENS`` shingles is
   searched in blocks, of one band or of two neighbouring ones, since others can't link.
5. Links form the components; classes unfold to documents.

Defined results: a null or empty text, or one without words, has an empty set, no links and
is its own component; a text of fewer than five words is one shingle; repeated rows are
copies of one class; a null id never becomes a component's id if another is there; other
columns are ignored. Texts of any length are used whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import BROADCAST_ROWS, dropped, staged
from lintel.llm.components import connected_components

WORDS, PERCENT = 5, 80
#: Counters of the rarity sketch (one byte each when sent), and the slices it is summed in.
SKETCH, SLICES = 1 << 22, 64
#: The most shingles of a family that one task holds; larger families go in pairs of blocks.
BLOCK_TOKENS = 1_500_000
#: DivideSkip's constant for the share of long lists.
MU = 0.0085
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000


class Shingler:
    """Texts to sorted distinct shingle hashes."""

    def __init__(self, width: int = WORDS):
        self.width, self.known = width, {}

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z, only \x20 and \x09-\x0D
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.word_hashes(text)
        k = min(self.width, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mixed(h ^ w[i : len(w) - k + 1 + i])
        return np.unique(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    h = (h + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def examined(tokens: np.ndarray) -> np.ndarray:
    """The shingles in the half of the hash range that is counted before anything else."""
    return tokens[(tokens >> np.uint64(39)) & np.uint64(1) == 1]


def least_shared(n: int, percent: int = PERCENT) -> int:
    """The smallest overlap that a set of n can have with any set it links to."""
    return -(-percent * n // 100)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows, of about ``size`` bytes at most where rows are long."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for s in range(0, batch.num_rows, step):
            yield batch.slice(s, step)


#: In the place of a class: a shingle that several classes of its batch hold, all credited in their batch.
CREDITED = np.int64(0)


def _by_bucket(ids: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its packed ids and counts)."""
    slot = (ids.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(slot, kind="stable")
    ids, n, slot = ids[order], n[order].astype(np.int32), slot[order]
    cuts = np.searchsorted(slot, np.arange(parts + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, ids[cuts[b] : cuts[b + 1]].tobytes() + n[cuts[b] : cuts[b + 1]].tobytes()


def _packed_sets(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows of three kinds from one reading of the texts: (_id, n, seen, cls) of each input row, ``seen`` counting the
    examined shingles; ``p, shingles``, a slice's packed shingles; ``p, credits``, a bucket's classes with the number of
    their shingles that other classes of their batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for part in _slices(batches, 4096):
            sets = [shingles(t) for t in part.column("_text").to_pylist()]
            seen = [examined(s) for s in sets]
            digests = [set_digest(s) for s in sets]
            own: dict[int, np.ndarray] = {}
            for d, s in zip(digests, seen, strict=True):
                if len(s):
                    own.setdefault(int.from_bytes(d[:8], "big", signed=True), s)
            ps, blobs, credits = [], [], []
            if own:
                names = np.append(np.array(list(own), np.int64), CREDITED)
                tokens = np.concatenate(list(own.values()))
                owner = np.repeat(np.arange(len(own), dtype=np.uint16), [len(s) for s in own.values()])
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                first = np.append(True, tokens[1:] != tokens[:-1])
                times = np.diff(np.append(np.flatnonzero(first), len(tokens)))
                several = np.repeat(times > 1, times)
                n = np.bincount(owner[several], minlength=len(own))
                credits = list(_by_bucket(names[:-1][n > 0], n[n > 0], parts))
                owner[several] = len(own)
                tokens, owner = tokens[first], owner[first]
                slot = (tokens >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(slot, kind="stable")
                cuts = np.searchsorted(slot[order], np.arange(parts + 1, dtype=np.uint64))
                low, owner = tokens[order].astype(np.uint32), owner[order]
                for p in range(parts):
                    a, b = cuts[p], cuts[p + 1]
                    if a < b:
                        local, index = np.unique(owner[a:b], return_inverse=True)
                        ps.append(p)
                        blobs.append(np.array([len(local), b - a], np.int64).tobytes() + names[local].tobytes() + index.astype(np.uint16).tobytes() + low[a:b].tobytes())
            k, none = part.num_rows, len(ps) + len(credits)
            ids = part.column("_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(none, ids.type)]),
                    pa.array([len(s) for s in sets] + [None] * none, pa.int64()),
                    pa.array([len(s) for s in seen] + [None] * none, pa.int64()),
                    pa.array(digests + [None] * none, pa.binary()),
                    pa.array([None] * k + ps + [b for b, _ in credits], pa.int32()),
                    pa.array([None] * k + blobs + [None] * len(credits), pa.binary()),
                    pa.array([None] * (k + len(ps)) + [x for _, x in credits], pa.binary()),
                ],
                names=["_id", "n", "seen", "cls", "p", "shingles", "credits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n bigint, seen bigint, cls binary, p int, shingles binary, credits binary")


def _shared_counts(packed: DataFrame, parts: int) -> DataFrame:
    """(cls64, shared): how many of a class's examined shingles occur in another class too."""

    def count(table: pa.Table) -> pa.Table:
        tokens, owners = [], []
        for blob in table.column("shingles").to_pylist():
            k, n = np.frombuffer(blob, np.int64, 2)
            names = np.frombuffer(blob, np.int64, k, 16)
            owners.append(names[np.frombuffer(blob, np.uint16, n, 16 + 8 * k)])
            tokens.append(np.frombuffer(blob, np.uint32, n, 16 + 8 * k + 2 * n))
        tok, own = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(tok)))) & (own != CREDITED)
        tok, own = tok[keep], own[keep]
        pairs = np.lexsort((tok, own))
        tok, own = tok[pairs], own[pairs]
        first = np.append(True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])) if len(tok) else np.zeros(0, bool)
        found = list(_by_bucket(*np.unique(own[first], return_counts=True), parts))
        return pa.table({"p": pa.array([b for b, _ in found], pa.int32()), "credits": pa.array([x for _, x in found], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        ids, n = [], []
        for blob in table.column("credits").to_pylist():
            k = len(blob) // 12
            ids.append(np.frombuffer(blob, np.int64, k))
            n.append(np.frombuffer(blob, np.int32, k, 8 * k))
        ids, at = np.unique(np.concatenate(ids), return_inverse=True)
        return pa.table({"cls64": pa.array(ids, pa.int64()), "shared": pa.array(np.bincount(at, np.concatenate(n)).astype(np.int64), pa.int64())})

    counted = packed.where("shingles is not null").select("p", "shingles").groupBy("p").applyInArrow(count, "p int, credits binary")
    credits = packed.where("credits is not null").select("p", "credits").unionByName(counted)
    return credits.groupBy("p").applyInArrow(add, "cls64 bigint, shared bigint")


def _class_sets(docs: DataFrame, survivors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, n, rows, tokens) for each surviving class, from the text of its representative; again for each row that repeats it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for part in _slices(batches):
            out = [(c, s, r) for t, c, r in zip(*(part.column(x).to_pylist() for x in ("_text", "cls", "rows")), strict=True) if set_digest(s := shingles(t)) == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary())],
                names=["cls", "n", "rows", "tokens"],
            )

    if survivors.count() <= BROADCAST_ROWS:
        survivors = F.broadcast(survivors)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(survivors, texts["_id"].eqNullSafe(survivors["rep"])).select("_text", "cls", "rows")
    return found.mapInArrow(run, "cls binary, n bigint, rows bigint, tokens binary")


def _rarity(sets: DataFrame) -> np.ndarray:
    """Count sketch of all shingles of ``sets``: SKETCH saturating logarithmic counters."""
    width = SKETCH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for part in _slices(batches, 512):
            tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in part.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            total += np.bincount((tokens >> np.uint64(42)).astype(np.int64), minlength=SKETCH).astype(np.int32)
        used = [k for k in range(SLICES) if total[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in used], pa.binary())], names=["k", "c"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in table.column("c").to_pylist():
            total += np.frombuffer(c, np.int32)
        level = np.minimum(255, np.rint(12 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"k": pa.array(table.column("k").to_pylist()[:1], pa.int32()), "c": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.uint8)
    for r in sets.select("tokens").mapInArrow(count, "k int, c binary").groupBy("k").applyInArrow(add, "k int, c binary").collect():
        out[r["k"] * width : (r["k"] + 1) * width] = np.frombuffer(r["c"], np.uint8)
    return out


def size_band(n: Column) -> Column:
    """Sets that can link are at most one band apart."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT * 1.0001)).cast("int")


def _postings(sets: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(tok, cls64): the rarest ``n - T + 1`` shingles of each class, once with its size band and once with the next, mixed into tok."""
    shared = sets.sparkSession.sparkContext.broadcast(rarity)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 512):
            tok, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for name, band, raw in zip(*(part.column(x).to_pylist() for x in ("cls64", "band", "tokens")), strict=True):
                t = np.frombuffer(raw, np.uint64)
                order = np.lexsort((t, shared.value[(t >> np.uint64(42)).astype(np.int64)]))
                chosen = t[order[: len(t) - least_shared(len(t)) + 1]]
                tok += [mixed(chosen + np.uint64(band)), mixed(chosen + np.uint64(band + 1))]
                own.append(np.full(2 * len(chosen), name, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(own))], names=["tok", "cls64"])

    return sets.select("cls64", "band", "tokens").mapInArrow(run, "tok bigint, cls64 bigint")


def merged_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of sorted lists and how often each occurs, by a heap merge."""
    ids: list[int] = []
    counts: list[int] = []
    for x in heapq.merge(*[x.tolist() for x in lists]):
        if ids and ids[-1] == x:
            counts[-1] += 1
        else:
            ids.append(x)
            counts.append(1)
    return np.array(ids, np.int64), np.array(counts, np.int64)


class Lists:
    """Inverted lists over ranked sets, each list in order of rank: one sorted array of (shingle, rank)."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        _, ids = np.unique(flat, return_inverse=True)
        self.count, self.ids = max(1, len(sets)), ids
        self.ends = np.cumsum(size)
        self.keys = np.sort(ids * self.count + np.repeat(np.arange(len(sets)), size))
        self.ranks = self.keys % self.count

    def of(self, r: int) -> np.ndarray:
        """The shingles of set r."""
        return self.ids[self.ends[r - 1] if r else 0 : self.ends[r]]

    def between(self, tokens: np.ndarray, after: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of each shingle's list, of ranks over ``after`` and under ``before``."""
        lo = np.searchsorted(self.keys, tokens * self.count + after, side="right")
        return lo, np.maximum(np.searchsorted(self.keys, tokens * self.count + before) - lo, 0)

    def entries(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Several lists, one after the other."""
        return self.ranks[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def held(self, token: int, ranks: np.ndarray) -> np.ndarray:
        """Which of the sets hold the shingle: a binary search each."""
        key = token * self.count + ranks
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key


def divide_skip(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT, small: int = 400) -> Iterator[tuple[int, np.ndarray]]:
    """Every linked pair once: (i, partners of i), as indexes of ``sets``. With ``side``, only pairs of different sides.

    Up to ``small`` entries of short lists are merged with a heap, more are counted in one vector step. Of the long lists
    those much longer than the candidates are probed, shorter ones counted likewise."""
    size = np.array([len(s) for s in sets], np.int64)
    by_size = np.argsort(size, kind="stable")
    n = size[by_size]
    lists = Lists([sets[i] for i in by_size])
    for r in range(len(sets)):
        if not n[r]:
            continue
        last = int(np.searchsorted(n, n[r] * 100 // percent, side="right"))  # sizes beyond can't reach the threshold
        if last <= r + 1:
            continue
        tokens = lists.of(r)
        lo, length = lists.between(tokens, r, last)
        need = -(-percent * 2 * int(n[r]) // (100 + percent))  # partners are at least as large
        used = np.flatnonzero(length)
        if len(used) < need:
            continue
        used = used[np.argsort(length[used], kind="stable")]
        tokens, lo, length = tokens[used], lo[used], length[used]
        long = min(need - 1, int(need / (MU * np.log2(length[-1] + 1) + 1)))
        cut = len(tokens) - long
        short = lists.entries(lo[:cut], length[:cut])
        if len(short) <= small:
            cand, count = merged_counts(np.split(short, np.cumsum(length[: cut - 1])))
        else:
            times = np.bincount(short - r, minlength=last - r)
            cand = np.flatnonzero(times)
            cand, count = cand + r, times[cand]
        keep = count >= need - long
        cand, count = cand[keep], count[keep]
        if len(cand):
            near = cut + int(np.searchsorted(length[cut:], 8 * len(cand), side="right"))
            if near > cut:
                count = count + np.bincount(lists.entries(lo[cut:near], length[cut:near]) - r, minlength=last - r)[cand - r]
            wanted = -(-percent * (n[r] + n[cand]) // (100 + percent))
            for k in range(near, len(tokens)):
                alive = count + (len(tokens) - k) >= wanted
                if not alive.all():
                    cand, count, wanted = cand[alive], count[alive], wanted[alive]
                if not len(cand):
                    break
                count = count + lists.held(tokens[k], cand)
        cand = cand[100 * count >= percent * (n[r] + n[cand] - count)]
        found = by_size[cand]
        if side is not None:
            found = found[side[found] != side[by_size[r]]]
        if len(found):
            yield int(by_size[r]), found


def _family_links(table: pa.Table) -> pa.Table:
    """Links within whole families, or between two blocks of one: per class its links to documents and the local root."""
    cls = table.column("cls").to_pylist()
    table = table.take([k for c, k in {c: k for k, c in enumerate(cls)}.items()])
    cls, rows, block = table.column("cls").to_pylist(), table.column("rows").to_numpy(), table.column("block").to_numpy()
    sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    one = all(table.column(a)[0] == table.column(b)[0] for a, b in ("xy", "ij"))
    parent = list(range(len(cls)))
    links = np.zeros(len(cls), np.int64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, partners in divide_skip(sets, None if one else block):
        links[a] += rows[partners].sum()
        links[partners] += rows[a]
        for b in partners.tolist():
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y, key=lambda k: cls[k])] = min(x, y, key=lambda k: cls[k])
    own = np.flatnonzero(links)
    return pa.table({"cls": pa.array([cls[k] for k in own], pa.binary()), "links": pa.array(links[own], pa.int64()), "root": pa.array([cls[find(k)] for k in own], pa.binary())})


def _searched(sized: DataFrame) -> DataFrame:
    """(cls, links, root) for ``sized(cls, n, band, rows, tokens, family)``.

    Small families are dealt out together. A larger one falls into blocks of a band; a block meets those of its own band
    and of the two beside it."""
    whole = sized.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-int(whole) // BLOCK_TOKENS))
    bands = sized.groupBy("family", "band").agg(F.sum("n").alias("n"))
    large = bands.groupBy("family").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / BLOCK_TOKENS).cast("int")))).alias("blocks"))
    large = staged(large.where(F.col("n") > BLOCK_TOKENS).select("family", "blocks"))
    placed = sized.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "family", "left")
    kept = ["cls", "rows", "tokens"]
    none = F.lit(0)
    small = placed.where("blocks is null").select(F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("g"), none.alias("block"), F.lit(None).cast("long").alias("family"), *[none.alias(c) for c in ("x", "i", "y", "j")], *kept)
    count = lambda band: F.coalesce(F.element_at("blocks", band), F.lit(0))
    numbered = placed.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("cls"), count(F.col("band"))).cast("int"))

    def pairs(step: int) -> Column:
        """The pairs (band, block, band, block) with the blocks of the band ``step`` on, the lower one first."""
        band = F.col("band") + step
        others = F.when(count(band) > 0, F.sequence(F.lit(0), count(band) - 1)).otherwise(F.array().cast("array<int>"))
        one, two = F.array("band", "own"), lambda o: F.array(band, o)

        def pair(o: Column) -> Column:
            lower, upper = F.least(one, two(o)), F.greatest(one, two(o))
            return F.struct(lower[0].alias("x"), lower[1].alias("i"), upper[0].alias("y"), upper[1].alias("j"))

        return F.transform(others, pair)

    dealt = numbered.withColumn("to", F.explode(F.concat(pairs(-1), pairs(0), pairs(1))))
    # 2 ** 24 blocks of a band would be 25 * 10 ** 12 shingles
    split = dealt.select(F.lit(-1).cast("long").alias("g"), (F.col("band") * (1 << 24) + F.col("own")).alias("block"), "family", "to.x", "to.i", "to.y", "to.j", *kept)
    return small.unionByName(split).groupBy("g", "family", "x", "i", "y", "j").applyInArrow(_family_links, "cls binary, links bigint, root binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links (documents that it links to)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = staged(_packed_sets(docs, id_col, text_col, parts))
    rows = staged(packed.where("cls is not null").select("_id", "n", "seen", "cls"))
    head = F.conv(F.substring(F.hex("cls"), 1, 16), 16, -10).cast("bigint").alias("cls64")
    classes = staged(rows.where("n > 0").groupBy("cls").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("seen").alias("seen"), F.count("*").alias("rows")).withColumn("cls64", head))
    alone = F.col("seen") - F.coalesce("shared", F.lit(0))
    may_link = alone <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    survivors = staged(classes.join(_shared_counts(packed, parts), "cls64", "left").where(may_link).select("cls", "rep", "rows"))
    dropped(packed)
    sets = staged(_class_sets(docs, survivors, id_col, text_col)).withColumns({"band": size_band(F.col("n")), "cls64": head})

    # families go by 64 bits of a class's digest: classes that agree in them share a family, no more
    posted = staged(_postings(sets, _rarity(sets)))
    stars = posted.groupBy("tok").agg(F.min("cls64").alias("b"), F.max("cls64").alias("other")).where("b <> other").drop("other")
    families = connected_components(posted.join(stars, "tok").where("cls64 <> b").select(F.col("cls64").alias("a"), "b").distinct())
    dropped(posted)
    sized = staged(sets.join(families.select(F.col("node").alias("cls64"), F.col("root").alias("family")), "cls64"))
    found = staged(_searched(sized))
    dropped(sized)
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    tree = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.join(tree.select(F.col("node").alias("cls"), "root"), "cls").join(linked, "cls", "left")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root")
    single = classes.join(tree.select(F.col("node").alias("cls")), "cls", "left_anti")
    every = named.select("cls", "rows", F.coalesce("links", F.lit(0)).alias("links"), "component").unionByName(
        single.where("rows > 1").select("cls", "rows", F.lit(0).cast("bigint").alias("links"), F.col("rep").alias("component"))
    )
    return (
        rows.join(every, (rows["cls"] == every["cls"]) & (rows["n"] > 0), "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.coalesce("rows", F.lit(1)) - 1).alias("n_links"),
        )
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; columns as they were.

    Rows are told apart by id and text, so that of several rows with one id only those that are copies go; null ids come
    last. Of rows that agree in id and text one stays."""
    key = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("i"), F.xxhash64(F.lit(1), F.col(text_col)).alias("g"), F.xxhash64(F.lit(2), F.col(text_col)).alias("h"))
    found = jaccard_components(docs.select(key.alias("__lx_key"), F.col(text_col).alias("__lx_text")), "__lx_key", "__lx_text")
    gone = staged(found.where("__lx_key <> component_id").select(F.col("__lx_key").alias("__lx_gone")).distinct())
    few = gone.count() <= BROADCAST_ROWS
    tagged = docs.withColumn("__lx_key", key)
    kept = tagged.join(F.broadcast(gone) if few else gone, F.col("__lx_key").eqNullSafe(F.col("__lx_gone")), "left_anti")
    if found.groupBy("__lx_key").count().where("count > 1").limit(1).count():
        kept = kept.withColumn("__lx_n", F.row_number().over(Window.partitionBy("__lx_key").orderBy(F.lit(0)))).where("__lx_n = 1")
    return kept.select(*[docs[c] for c in docs.columns])
