"""Words of many texts at once, with numpy: places, 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at once; the tables of powers are no longer than twice that, or the longest word (8 MB otherwise).
_STRETCH = 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix64(h: np.ndarray) -> np.ndarray:
    """A finisher that spreads every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    up, down = _powers(max(19, int(n).bit_length()))
    return up[:n], down[:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """P with hash of buf[a:b] = (P[b] - P[a]) * BASE^-a."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


class Words:
    """The words (runs without ASCII white space) of texts given as UTF-8 bytes; a word never crosses texts."""

    def __init__(self, raws: list[bytes]) -> None:
        self.buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        self.ends_of_text = np.cumsum(sizes)
        self.starts_of_text = self.ends_of_text - sizes
        blank = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.blank = blank
        #: Word number at which each text begins; one more at the end.
        self.first = np.r_[np.searchsorted(self.start, self.starts_of_text), len(self.start)]
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """By stretches, so that memory does not follow the longest text (only the longest word)."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            base = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, base + _STRETCH, "right")))
            a, b = self.start[at:to] - base, self.end[at:to] - base
            p = prefix(self.buf[base : base + int(b[-1])])
            out[at:to] = mix64((p[b] - p[a]) * powers(int(b[-1]) + 1)[1][a] + (b - a).astype(np.uint64))
            at = to
        return out


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words, by its first word."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix64(out)


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; the whole sequence as one if it is shorter; none without words."""
    words = Words(raws)
    h = words.hashes()
    wide = runs(h, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            out.append(mix64(runs(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
