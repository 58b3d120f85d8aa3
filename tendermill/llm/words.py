"""Words of whole batches of texts as NumPy arrays: no loop over words or characters.

A word is a run of bytes other than space and 0x09-0x0D. In UTF-8 these bytes never occur inside
a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PRIMES = np.array([(1 << 31) - 1, (1 << 31) - 19], dtype=np.uint64)
BASES = (1_210_341_739, 1_848_773_521)
#: Masks of the first bytes of a block.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
INVERSES = tuple(pow(b, -1, int(p)) for b, p in zip(BASES, PRIMES))
#: Odd multipliers for the places of an n-gram.
PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def give_back() -> None:
    """Return free memory to the system: workers serve one stage after another and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = 1 << 20):
    """(first row, bytes, offsets) of consecutive rows holding about ``limit`` bytes; a longer text is a piece of its own.

    Null counts as empty.
    """
    column = column.fill_null("").cast(pa.large_binary())
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(where, dtype=np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, data[at[first]: at[last]], at[first: last + 1] - at[first]
        first = last


def stretches(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``member`` bytes inside texts, and for each text the number of runs before it."""
    if not len(member):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(len(member), dtype=bool)
    before[0], before[1:] = True, ~member[:-1]
    before[full] = True
    after = np.empty(len(member), dtype=bool)
    after[-1], after[:-1] = True, ~member[1:]
    after[full[1:] - 1] = True
    starts = np.flatnonzero(before & member)
    ends = np.flatnonzero(after & member) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one entry more than texts)."""
    return stretches(~SPACE[data], offsets)


class Hasher:
    """64-bit hashes of byte ranges; equal ranges get equal hashes wherever they lie.

    Ranges of up to ``SHORT`` bytes are mixed block by block, eight bytes at a time; those of eight bytes or less meet
    no other of their length. Longer ones are polynomials in two primes below 2^31 by prefix sums, so no structure
    of the bytes (as with a modulus that is a power of two) makes different ranges meet.
    """

    SHORT = 64

    def __init__(self) -> None:
        self.size = 0

    def _powers(self, n: int) -> None:
        self.size = max(n + 1, 1 << 20)
        self.up, self.down = ([_powers(x, p, self.size) for x, p in zip(bases, PRIMES)] for bases in (BASES, INVERSES))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = ends - starts
        out = mix(length.astype(np.uint64) * PLACES[7] + PLACES[6])
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        block = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        long = length > self.SHORT
        open_ = np.flatnonzero((length > 0) & ~long)
        for done in range(0, self.SHORT, 8):
            if not len(open_):
                break
            left = length[open_] - done
            own = block[starts[open_] + done] & FIRST[np.minimum(left, 8)]
            out[open_] = mix(out[open_] ^ own)
            open_ = open_[left > 8]
        if long.any():
            out[long] = self._polynomials(data, starts[long], ends[long], out[long])
        return out

    def _polynomials(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
        n = len(data)
        if self.size <= n:
            self._powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        for k, p in enumerate(PRIMES):
            terms = self.up[k][:n] * data
            if n >= 1 << 24:
                terms %= p  # so that the sums stay below 2^64
            np.cumsum(terms, out=sums[1:])
            out = mix(out ^ (sums[ends] - sums[starts]) % p * self.down[k][starts] % p)
        return out


def _powers(base: int, prime: np.uint64, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    done, factor = 1, base
    while done < size:
        more = min(done, size - done)
        out[done: done + more] = out[:more] * np.uint64(factor) % prime
        done, factor = done + more, factor * factor % int(prime)
    return out


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words, those across two texts included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for place in range(size):
        total += hashes[place: place + n] * PLACES[place]
    return mix(total)


class Memo:
    """Numbers the distinct hashes it has seen, so that work is done once for each and looked up afterwards."""

    def __init__(self, limit: int = 2_000_000) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    @property
    def full(self) -> bool:
        return len(self.known) > self.limit

    def see(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every hash, and the places of the new ones in the order of their numbers."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        number = np.empty(len(distinct), dtype=np.int64)
        number[hit] = self.number[at[hit]]
        number[~hit] = len(self.known) + np.arange((~hit).sum())
        self.number = np.insert(self.number, at[~hit], number[~hit])
        self.known = np.insert(self.known, at[~hit], distinct[~hit])
        return number[inverse], first[~hit]


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
