"""A suffix array by two-stage sorting, as vector operations."""

from __future__ import annotations

import numpy as np


def packed(text: np.ndarray, beyond: int) -> np.ndarray:
    """For each position its next eight bytes as a big-endian number; ``beyond`` more positions of zeros follow."""
    padded = np.concatenate([text, np.zeros(beyond + 8, np.uint8)]).astype(np.uint64)
    out = padded
    for step in (1, 2, 4):  # 1, then 2, 4 and 8 bytes at a time
        out = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Type B: suffixes smaller than the suffix that starts one later. The last one, with nothing after it, isn't."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    out = np.zeros(n, bool)
    if len(change):
        upto = change[-1] + 1
        at = change[np.searchsorted(change, np.arange(upto))]  # the end of the run that each position lies in
        out[:upto] = text[at] < text[at + 1]
    return out


def sorted_directly(positions: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """``positions`` in the order of the ``depth`` bytes that start there: sorts by eight bytes, then ties by the next eight."""
    order = positions[np.argsort(keys[positions], kind="stable")]
    tied = np.append(keys[order[1:]] == keys[order[:-1]], False)
    for off in range(8, depth, 8):
        within = tied | np.append(False, tied[:-1])
        at = np.flatnonzero(within)
        if not len(at):
            break
        group = np.cumsum(~np.append(False, tied[at[:-1]] & (at[1:] == at[:-1] + 1)))
        own = order[at]
        key = keys[own + off]
        resorted = np.lexsort((key, group))
        own, key = own[resorted], key[resorted]
        order[at] = own
        tied[at[:-1]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        tied[at[-1]] = False
    return order


def two_stage(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, packed keys) of bytes, exact to ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly. All others are induced:
    buckets are scanned by first byte in ascending order, and a scanned suffix puts its
    predecessor, if that is not of the sorted kind, at the next free place of the
    predecessor's bucket. Scans take a bucket's entries at once; entries that land in the
    bucket being scanned are taken in a further round.
    """
    n = len(text)
    keys = packed(text, depth)
    small = smaller_than_successor(text)
    counts_a = np.bincount(text[~small], minlength=256)
    counts_b = np.bincount(text[small], minlength=256)
    start = np.concatenate([[0], np.cumsum(counts_a + counts_b)[:-1]])
    out = np.full(n, -1, np.int64)
    direct = sorted_directly(np.flatnonzero(small), keys, depth)
    first = np.concatenate([[0], np.cumsum(counts_b)])
    for c in np.flatnonzero(counts_b):
        at = start[c] + counts_a[c]
        out[at : at + counts_b[c]] = direct[first[c] : first[c + 1]]
    head = start.copy()
    if n:
        out[head[text[-1]]] = n - 1  # follows from the empty suffix
        head[text[-1]] += 1

    def induce(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            runs = np.bincount(byte, minlength=256)
            rank = np.arange(len(before)) - np.repeat(np.cumsum(runs) - runs, runs)
            out[head[byte] + rank] = before
            head[:] += runs

    for c in np.flatnonzero(counts_a + counts_b):
        done = start[c]
        while done < head[c]:
            upto = head[c]
            induce(out[done:upto])
            done = upto
        induce(out[start[c] + counts_a[c] : start[c] + counts_a[c] + counts_b[c]])
    return out, keys


def common_prefixes(order: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """For neighbours in ``order``: how many bytes their common prefix has, counted up to ``most`` (a multiple of 8)."""
    out = np.full(max(0, len(order) - 1), most, np.int64)
    same = np.arange(len(out))
    for off in range(0, most, 8):
        apart = keys[order[same] + off] ^ keys[order[same + 1] + off]
        ends = apart != 0
        out[same[ends]] = off + sum((apart[ends] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        same = same[~ends]
    return out
