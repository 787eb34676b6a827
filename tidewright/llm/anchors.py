"""Anchors: of each window of bytes one short gram that only its content decides."""

from __future__ import annotations

import numpy as np

GRAM = 16


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place; GRAM - 1 fewer than data."""
    h = data.astype(np.uint64)
    h += np.uint64(1)
    span, base = 1, np.uint64(0x9E3779B97F4A7C15)
    while span < GRAM:
        h = h[:-span] * base + h[span:] if len(h) > span else h[:0]
        base *= base
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def owners(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the place of its least one, the first of equals."""
    at = np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        if len(at) <= step:
            return at[:0]
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        span += step
    return at


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of length bytes inside the documents of data (ends: n + 1 offsets).

    place, hash, first, count: the anchor's first byte, its hash, and the windows that it stands
    for, which begin at first, first + 1, ...
    """
    none = np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
    own = owners(h, length - GRAM + 1)
    if not len(own):
        return none, none.astype(np.uint64), none, none
    inside = np.zeros(len(own) + 1, np.int32)
    lens = np.diff(ends)
    big = np.flatnonzero(lens >= length)
    np.add.at(inside, ends[:-1][big], 1)
    np.add.at(inside, np.minimum(ends[:-1][big] + lens[big] - length + 1, len(own)), -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(start):
        return none, none.astype(np.uint64), none, none
    place = own[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(start) != 1)])
    return place[new].astype(np.int64), h[place[new]], start[new], np.diff(np.r_[new, len(start)])


def pieces(ends: np.ndarray, length: int, limit: int = 1 << 22):
    """lo, hi, own ends: parts of about limit bytes that together hold each window of length bytes once."""
    i, n = 0, len(ends) - 1
    while i < n:
        lo = int(ends[i])
        if ends[i + 1] - lo > limit:  # a long document by itself, in parts that overlap by length - 1
            hi = int(ends[i + 1])
            for at in range(lo, max(lo + 1, hi - length + 1), limit):
                to = min(hi, at + limit + length - 1)
                yield at, to, np.array([0, to - at])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, lo + limit, "right")) - 1)
        yield lo, int(ends[j]), ends[i : j + 1] - lo
        i = j


def all_anchors(data: np.ndarray, ends: np.ndarray, length: int, limit: int = 1 << 22) -> list[np.ndarray]:
    """place, hash, first, count of all anchors, with bounded memory besides the result."""
    found = []
    for lo, hi, own in pieces(ends, length, limit):
        place, h, first, count = anchors(data[lo:hi], own, length)
        found.append((place + lo, h, first + lo, count))
    if not found:
        none = np.empty(0, np.int64)
        return [none, none.astype(np.uint64), none, none]
    return [np.concatenate(x) for x in zip(*found, strict=True)]
