"""Vectorised hashes of words and word windows over a text's UTF-8 bytes.

Every byte stands for a random 64-bit number; a word or window is the sum of its members'
numbers times powers of an odd base, modulo 2**64, taken from one prefix sum. Each result then
passes a 64-bit finaliser. Words that are equal as bytes have equal hashes on every machine and
in every process.
"""

from __future__ import annotations

import numpy as np

#: White space that parts words: space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What parts runs of letters: every ASCII byte that isn't one.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 4096)
            both = []
            for factor in (self.base, self.inverse):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = both
        return self.up, self.down


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
IN_WORD, IN_WINDOW, IN_WINDOW_2 = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5), Powers(0xDA942042E4DD58B5)


def bounds(data: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = parting[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * IN_WORD.upto(len(data))[0][: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    down = IN_WORD.upto(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = bounds(data)
    return spans(prefix_sums(data), starts, ends)


def windows(values: np.ndarray, width: int, powers: Powers = IN_WINDOW) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values; none if there are fewer values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values
