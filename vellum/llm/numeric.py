"""Vectorised building blocks: rolling hashes, sliding minima, hash tables, connected labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes

_M1 = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of data, by doubling; k <= len(data)."""
    power = data.astype(np.uint64) * _M1 + np.uint64(0x1234567)
    power ^= power >> np.uint64(29)
    base, width, done, out = _BASE, 1, 0, None
    while k:
        if k & 1:
            if out is None:
                out = power.copy()
            else:
                n = min(len(out), len(power) - done)
                out = out[:n] * np.uint64(base) + power[done : done + n]
            done += width
        k >>= 1
        if k:
            power = power[:-width] * np.uint64(base) + power[width:]
            base, width = base * base % 2**64, width * 2
    return mix(out)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted table from several of (keys, counts)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


class HashIndex:
    """Open addressing over distinct uint64 keys; find() gives each key's place in the list, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot, the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._home(keys)
        got = self.slots[at]
        good = (got >= 0) & (self.keys[got] == keys)
        out[good] = got[good]
        todo = np.flatnonzero((got >= 0) & ~good)
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slots[at]
            good = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[good]] = got[good]
            on = (got >= 0) & ~good
            todo, at = todo[on], at[on]
        return out


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the undirected edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def byte_words(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the bytes marked in `inside` (256 flags) in each text, A to Z lower-cased: all their bytes on end, the length
    and the row of each. A run does not go on from one text to the next."""
    data, offsets = text_bytes(texts)
    marked = inside[data]
    heads, ends = marked.copy(), marked.copy()
    heads[1:] &= ~marked[:-1]
    ends[:-1] &= ~marked[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # where a text begins, a run does and the one before ends
    heads[first] = marked[first]
    last = first[first > 0] - 1
    ends[last] = marked[last]
    starts = np.flatnonzero(heads)
    lengths = np.flatnonzero(ends) + 1 - starts
    letters = data[marked]
    return np.where((letters >= 0x41) & (letters <= 0x5A), letters + np.uint8(32), letters), lengths, np.searchsorted(offsets, starts, "right") - 1
