"""Spelling variants by partition-and-enumerate signatures over letter multisets.

The letters of a word, with their counts, are a binary vector: letter and copy are its dimensions. A replaced letter
changes two dimensions, an inserted or deleted one changes one, so near words have vectors at a Hamming distance of at
most two. The letters are dealt over ``parts`` second-level parts (there is one first-level part). Words of one length
differ in at most two of them and agree on some choice of ``parts - 2``; words of neighbouring lengths differ in
one and agree on some choice of ``parts - 1``. Each choice gives a word one signature, made of its letters in these
parts and of the (shorter) length; near words share one, and an equi-join of the signatures finds every pair. Each pair is
then verified by its edit distance.

Rows that share a signature are compared as arrays, all pairs of some groups at once. A signature that more than
``GROUP`` rows share (words of few letters) is split by a second key: the word without its letter in one place. Near
words share that as well, and rows that share it are near already, so such a group costs what it has to report.

Words are counted where their texts lie: a task counts each distinct run once and looks it up afterwards.

Defined results: null text has no words; a null doc_id deletes as if it were written ``null``; repeated rows count each;
the forms of words are chains to ever more frequent ones (twice as frequent each time), so roots are found in a number
of rounds that grows with the logarithm of the longest chain; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.store import checkpointed, small_side, stored

#: One run in so many loses a letter; the shortest word; the least number of its occurrences.
DELETED, SHORTEST, LEAST = 97, 5, 3
#: A form occurs at least so many times as often as its word.
FACTOR = 2
PARTS = 7
#: Rows of a signature from which on it is split by a second key.
GROUP = 512
#: Longest word that is compared in an array, pairs that are compared at once, and a bit for each of eight bytes.
_WIDE, _PAIRS, _EACH = 64, 1 << 16, np.uint64(0x0101010101010101)
#: Rows that are looked at together.
_ROWS = 1 << 16
#: Distinct runs, and their bytes, that a task holds before their counts leave.
_RUNS, _BYTES = 500_000, 32 << 20

_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_LONGEST = 64


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF."""
    member = _ASCII[data]
    lead = data == _LEAD
    member |= lead
    member[1:] |= lead[:-1]
    return member


def _shift_tables() -> np.ndarray:
    """What so many zero bytes make of each byte of a checksum."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.empty((_LONGEST + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _LONGEST + 1):
        out[n] = byte[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


class Joined:
    """crc32 of a head and a run from the crc32 of each."""

    def __init__(self) -> None:
        self.tables = _shift_tables().reshape(-1)

    def __call__(self, head: np.ndarray, run: np.ndarray, length: np.ndarray) -> np.ndarray:
        head, left = head.copy(), length.copy()
        open_ = np.flatnonzero(left > 0)
        while len(open_):
            step, x = np.minimum(left[open_], _LONGEST), head[open_]
            at = step * 1024
            head[open_] = (self.tables[at + (x & 0xFF)] ^ self.tables[at + 256 + (x >> 8 & 0xFF)]
                           ^ self.tables[at + 512 + (x >> 16 & 0xFF)] ^ self.tables[at + 768 + (x >> 24)])
            left[open_] -= step
            open_ = open_[left[open_] > 0]
        return run ^ head


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", deleted: int = DELETED, shortest: int = SHORTEST,
                least: int = LEAST) -> DataFrame:
    """(word, n) of the lower-cased runs of letters, after a letter was deleted from those that the checksum chooses."""

    def run(batches):
        hasher, memo, joined, places = words.Hasher(), words.Memo(), Joined(), _Runs()

        def counts():
            found = Counter(places.loose)
            for word, n in zip(places.words, places.count.tolist()):
                if n:
                    found[word.decode("utf-8")] += n
            kept = [(w, n) for w, n in found.items() if len(w) >= shortest]
            memo.clear()
            places.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            heads = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], dtype=np.uint32)
            for first, data, offsets in words.pieces(batch.column(1)):
                data = words.LOWER[data]
                starts, ends, upto = words.stretches(letters(data), offsets)
                number, new = memo.see(hasher.ranges(data, starts, ends))
                places.add(data.tobytes(), starts[new], ends[new])
                row = first + np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
                drawn = joined(heads[row], places.crc[number], ends - starts)
                gone = drawn % np.uint32(deleted) == 0
                places.count += np.bincount(number[~gone], minlength=len(places.count))
                for k, h in zip(number[gone].tolist(), drawn[gone].tolist()):
                    word = places.words[k].decode("utf-8")
                    at = h % len(word)
                    places.loose[word[:at] + word[at + 1:]] += 1
                if len(places.words) > _RUNS or places.bytes > _BYTES or len(places.loose) > _RUNS:
                    yield counts()
        yield counts()

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Runs:
    """The distinct runs of a task: bytes, crc32, occurrences; and the words that lost a letter."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.words, self.crc, self.count, self.bytes = [], np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        self.loose: Counter = Counter()

    def add(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        more = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.words += more
        self.crc = np.concatenate((self.crc, np.array([zlib.crc32(w) for w in more], dtype=np.uint32)))
        self.count = np.concatenate((self.count, np.zeros(len(more), np.int64)))
        self.bytes += int((ends - starts).sum())


#: What a row of a signature stands for: a word among those of its length, the shorter or the longer of two lengths.
SAME, SHORTER, LONGER = 0, 1, 2


def signatures(counted: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, role, word, n): a row for each choice of parts, those of neighbouring lengths under both lengths."""
    chosen = [*combinations(range(parts), 2), *((k, parts) for k in range(parts))]  # parts left out; the last one is always empty
    pairs = len(chosen) - parts

    def run(batches):
        first, second = (np.array(x) for x in zip(*chosen))
        place = words.mix(np.arange(1, len(chosen) + 1, dtype=np.uint64) * words.PLACES[0])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                word = some.column(0).to_pylist()
                length = np.array([len(w) for w in word], dtype=np.int64)
                letter = np.frombuffer("".join(word).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                row = np.repeat(np.arange(len(word)), length)
                # the sum of a part's letters tells multisets apart; what meets by chance is sorted out by the check of the pair
                sums = np.zeros((len(word), parts + 1), dtype=np.uint64)
                np.add.at(sums, (row, (letter % np.uint64(parts)).astype(np.int64)), words.mix(letter * words.PLACES[1]))
                left = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums[:, first] - sums[:, second]
                size = length.astype(np.uint64)[:, None]
                own, below = (words.mix(left + place + (size - np.uint64(less)) * words.PLACES[2]) for less in (0, 1))
                keys = np.concatenate([own[:, :pairs].ravel(), own[:, pairs:].ravel(), below[:, pairs:].ravel()]).view(np.int64)
                role = np.repeat(np.array([SAME, SHORTER, LONGER], dtype=np.int8), np.array([pairs, parts, parts]) * len(word))
                of = pa.array(np.concatenate([np.repeat(np.arange(len(word)), k) for k in (pairs, parts, parts)]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(role), some.column(0).take(of), some.column(1).take(of)],
                                                 names=["key", "role", "word", "n"])

    return counted.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")


def _without_one(word: Column) -> Column:
    """The word without its letter in each place: (place, rest)."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.struct(
        i.alias("place"), F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word))).alias("rest")))


def _near(a: str, b: str) -> bool:
    """Do two words differ by one letter replaced, or by one that the longer ``b`` has more?"""
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a != b and a[at + (len(a) == len(b)):] == b[at + 1:]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes blocks of eight differ."""
    x = a ^ b
    for shift in (4, 2, 1):
        x |= x >> np.uint64(shift)
    return np.bitwise_count(x & _EACH)


def _replaced(blocks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of words of one length differ in one letter; a column of ``blocks`` holds eight letters."""
    n = _differing(blocks[left, 0], blocks[right, 0])
    for k in range(1, blocks.shape[1]):
        n += _differing(blocks[left, k], blocks[right, k])
    return n == 1


def _inserted(grid: np.ndarray, length: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which right words are the left ones with one letter more."""
    a, b, n = grid[left], grid[right], length[left][:, None]
    place = np.arange(grid.shape[1])
    differ = (a != b) & (place < n)
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), n[:, 0])[:, None]
    moved = (a[:, :-1] != b[:, 1:]) & (place[:-1] >= at) & (place[:-1] < n)
    return (length[right] == length[left] + 1) & ~moved.any(axis=1)


def _near_in_groups(rows: DataFrame) -> DataFrame:
    """(a, na, b, nb): near words among the rows of each key."""
    names = ["key", "role", "word", "n"]

    def of_groups(table: pa.Table, ends: np.ndarray):
        """Near pairs in whole groups: the rows up to each of ``ends``."""
        role = table.column("role").to_numpy()
        column = table.column("word").combine_chunks()
        word = column.to_pylist()
        length = np.array([len(w) for w in word], dtype=np.int64)
        try:
            codes, narrow = "".join(word).encode("latin-1"), length <= _WIDE
        except UnicodeEncodeError:
            codes = "".join(word).encode("latin-1", "replace")
            narrow = (length <= _WIDE) & np.array([max(w, default="a") <= "\xff" for w in word])
        grid = np.zeros((len(word), _WIDE + 8), dtype=np.uint8)
        at = np.cumsum(length) - length
        held = np.minimum(length, _WIDE + 8)
        grid[np.repeat(np.arange(len(word)), held), words.gather(np.zeros_like(held), held)] = np.frombuffer(codes, np.uint8)[words.gather(at, held)]
        first = np.concatenate(([0], ends[:-1]))
        blocks = np.minimum(np.maximum.reduceat(length, first) // 8 + 1, _WIDE // 8 + 1)
        longer = np.add.reduceat((role == LONGER).astype(np.int64), first)
        # rows of words of two lengths come with the shorter words first
        size = ends - first
        before = np.where(role[first] == SAME, 0, np.where(longer == size, size, size - longer))
        fits = np.logical_and.reduceat(narrow, first) & (np.minimum.reduceat(length, first) == np.maximum.reduceat(length, first) - (before > 0))
        kinds = np.column_stack((~fits, before, size, blocks))
        kinds, of = np.unique(kinds, axis=0, return_inverse=True)
        of = of.ravel()
        by = np.argsort(of, kind="stable")
        upto = np.cumsum(np.bincount(of, minlength=len(kinds)))
        views = {nb: np.ascontiguousarray(grid[:, : 8 * nb]) for nb in np.unique(blocks).tolist()}
        found = []
        for k, (odd, s, m, nb) in enumerate(kinds.tolist()):
            if m < 2 or s == m:
                continue
            i, j = np.divmod(np.arange(s * (m - s)), m - s) if s else np.triu_indices(m, 1)
            j = j + s
            begin = first[by[upto[k - 1] if k else 0: upto[k]]]
            many = max(1, _PAIRS // len(i))
            for c in range(0, len(begin), many):
                x, y = ((begin[c: c + many, None] + z).ravel() for z in (i, j))
                if odd:  # long words, other letters, or signatures that meet by chance
                    good = [len(word[v]) - len(word[u]) == (s > 0) and _near(word[u], word[v]) for u, v in zip(x.tolist(), y.tolist())]
                elif s:
                    good = _inserted(views[nb], length, x, y)
                else:
                    good = _replaced(views[nb].view(np.uint64), x, y)
                found.append((x[good], y[good]))
        x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        later = np.array([len(word[u]) == len(word[v]) and word[u] > word[v] for u, v in zip(x.tolist(), y.tolist())], dtype=bool)
        x, y = np.where(later, y, x), np.where(later, x, y)
        n = table.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays([column.take(pa.array(x)), n.take(pa.array(x)), column.take(pa.array(y)), n.take(pa.array(y))],
                                          names=["a", "na", "b", "nb"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(ends):
                yield of_groups(table.slice(0, int(ends[-1])), ends)
                held = table.slice(int(ends[-1])).to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            yield of_groups(table, np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, size))

    together = rows.select(*names).repartition("key").sortWithinPartitions("key", "role")
    return together.mapInArrow(run, "a string, na long, b string, nb long")


def near_words(counted: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """(a, na, b, nb): each pair of words that differ by one inserted, deleted or replaced letter, once."""
    rows = signatures(counted, parts)
    often = checkpointed(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("key"))
    often = small_side(often)
    # words of one length agree without the letter in one place; of two lengths, the shorter is the longer without one
    word, role = F.col("word"), F.col("role")
    whole = F.array(F.struct(F.lit(0).alias("place"), word.alias("rest")))
    cuts = F.array_distinct(F.transform(_without_one(word), lambda c: F.struct(F.lit(0).alias("place"), c["rest"].alias("rest"))))
    second = F.when(role == SAME, _without_one(word)).when(role == SHORTER, whole).otherwise(cuts)
    split = rows.join(often, "key").select("key", "role", "word", "n", F.explode(second).alias("cut"))
    split = split.select(F.xxhash64("key", "cut.place", "cut.rest").alias("key"), "role", "word", "n")
    return _near_in_groups(rows.join(often, "key", "left_anti").unionByName(split)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms, for words that have one; each round doubles the steps taken."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("end"))
        now = checkpointed(now.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR, parts: int = PARTS,
                      group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    counted = stored(word_counts(docs, doc_id, text))
    pairs = stored(near_words(counted, parts, group))
    sides = [pairs.select(F.col(x).alias("word"), F.col(f"n{x}").alias("n"), F.col(y).alias("other"), F.col(f"n{y}").alias("other_n")) for x, y in ("ab", "ba")]
    near = sides[0].unionByName(sides[1]).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    near = near.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"), "n")
    near = stored(near.withColumns({c: F.when(F.col("form_n") >= factor * F.col("n"), F.col(c)) for c in ("form", "form_n")}).drop("n"))
    ends = roots(near.where("form IS NOT NULL"))
    return counted.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
