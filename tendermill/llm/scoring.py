"""Language-model scores by a weighted backoff automaton over words.

States are histories: a word, or the start of a text. A seen bigram is an arc with the probability
(c(h w) + PRIOR P(w)) / (c(h) + PRIOR). Any other word takes the failure arc of the state, weighed
PRIOR / (c(h) + PRIOR), to the unigram state, where a seen word has (c - D) / N and all unknown words together
D V / N, with D from the words seen once. A text is read once from left to right: state and sum of
log-probabilities are carried along.

Counts cover all training texts and are never held whole: texts form blocks of words, a block asks for the counts of its
distinct words and bigrams, requests meet by hash in buckets of bounded size, and answers go back to their block.
A word as frequent as any asks once per block. Each block then holds the part of the automaton that its texts can reach.

Defined results: null or blank text is the end token alone; a null doc_id is a text like others and counts as training;
repeated rows are texts of their own; without training texts the score is that of a model knowing no word;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.store import stored

#: Tokens of a block, and tokens whose requests share a bucket.
BLOCK, BUCKET = 2_000_000, 4_000_000
#: Weight of the unigram in a bigram's probability.
PRIOR = 200.0
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_TABLE = "block long, doc_id array<long>, held array<boolean>, tokens array<int>, vocabulary binary, places binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as places in their block's vocabulary of word hashes; every text ends with the end token."""

    def run(batches):
        hasher, number = words.Hasher(), 0
        task = TaskContext.get().partitionId()
        ids, held, sizes, hashes, n = [], [], [], [], 0

        def block():
            vocabulary, places = np.unique(np.concatenate(hashes), return_inverse=True)
            columns = [pa.array([(task << 32) + number]), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([sum(held, [])], pa.list_(pa.bool_())),
                       pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([vocabulary.tobytes()], pa.binary()),
                       pa.array([places.astype(np.uint32).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "held", "tokens", "vocabulary", "places"])

        for batch in batches:
            for first, data, offsets in words.pieces(batch.column(2)):
                data, m = words.LOWER[data], len(offsets) - 1
                starts, ends, upto = words.spans(data, offsets)
                hashes.append(np.insert(hasher.ranges(data, starts, ends), upto[1:], _END))
                sizes.append((np.diff(upto) + 1).astype(np.int32))
                ids.append(batch.column(0).slice(first, m).to_pylist())
                held.append(batch.column(1).slice(first, m).to_pylist())
                n += len(hashes[-1])
                if n >= BLOCK:
                    yield block()
                    number, n = number + 1, 0
                    for x in (ids, held, sizes, hashes):
                        x.clear()
        if n:
            yield block()

    return docs.mapInArrow(run, _TABLE)


class Block:
    """A block's words or bigrams as requests: keys in a fixed order, and their training counts."""

    def __init__(self, held, tokens, vocabulary, places) -> None:
        self.vocabulary = np.frombuffer(vocabulary.as_buffer(), dtype=np.uint64)
        self.places = np.frombuffer(places.as_buffer(), dtype=np.uint32).astype(np.int64)
        self.tokens = tokens.values.to_numpy()
        self.train = np.repeat(~held.values.to_numpy(zero_copy_only=False), self.tokens)
        self.first = np.cumsum(self.tokens, dtype=np.int64) - self.tokens

    def histories(self) -> np.ndarray:
        """The place of the word before each token; the vocabulary's size at the start of a text."""
        out = np.empty_like(self.places)
        out[1:] = self.places[:-1]
        out[self.first] = len(self.vocabulary)
        return out

    def requests(self, order: int):
        """(keys, training counts, place of each token's key)"""
        if order == 1:
            return self.vocabulary, np.bincount(self.places[self.train], minlength=len(self.vocabulary)), self.places
        history, size = self.histories(), len(self.vocabulary)
        arcs, of = np.unique(history * size + self.places, return_inverse=True)
        known = np.append(self.vocabulary, _START)
        keys = words.mix(known[arcs // size] * words.PLACES[0] + self.vocabulary[arcs % size] * words.PLACES[1])
        return keys, np.bincount(of[self.train], minlength=len(arcs)), of


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32 if counts.max() < 1 << 32 else np.uint64)


def _counts(blob, width: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), dtype={1: np.uint8, 4: np.uint32, 8: np.uint64}[width])


def asked(table: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, bucket, width, keys, counts): the requests of every block for words (order 1) or bigrams (2)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, _ = Block(*(batch.column(c)[i] for c in ("held", "tokens", "vocabulary", "places"))).requests(order)
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                bucket, keys, counts = bucket[by], keys[by], _narrow(counts[by])
                at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(at[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[i].as_py()] * len(at)), pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), counts.itemsize, np.int32)),
                     pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
                    names=["block", "bucket", "width", "keys", "counts"])

    return table.mapInArrow(run, "block long, bucket int, width int, keys binary, counts binary")


def answered(requests: DataFrame) -> DataFrame:
    """The total counts of the requested keys, in their order; each bucket adds a row without block: total, distinct and single keys."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group.column("keys")]
        counts = [_counts(x, w) for x, w in zip(group.column("counts"), group.column("width").to_pylist())]
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([c.astype(np.float64) for c in counts]), len(distinct)).astype(np.int64)
        at = np.cumsum([len(k) for k in keys])
        replies = [_narrow(total[o]) for o in np.split(of, at[:-1])]
        rows = len(replies)
        return pa.table({
            "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array(group.column("bucket").to_pylist() + [group.column("bucket")[0].as_py()], pa.int32()),
            "width": pa.array([r.itemsize for r in replies] + [0], pa.int32()), "answer": pa.array([r.tobytes() for r in replies] + [b""], pa.binary()),
            "total": pa.array([0] * rows + [int(total.sum())], pa.int64()), "distinct": pa.array([0] * rows + [int((total > 0).sum())], pa.int64()),
            "single": pa.array([0] * rows + [int((total == 1).sum())], pa.int64())})

    return requests.groupBy("bucket").applyInArrow(run, "block long, bucket int, width int, answer binary, total long, distinct long, single long")


def lm_scores(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; ``held_out`` tells from a doc_id column
    which texts are kept from training."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(doc_id).cast("long")), F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    table = stored(blocks(docs), "zstd")
    tokens = table.select(F.sum(F.length("places") / 4)).first()[0] or 0
    buckets = max(8, int(tokens) // BUCKET + 1)
    one, two = (stored(answered(asked(table, order, buckets)), "zstd") for order in (1, 2))
    total, distinct, single = one.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "single"))).first()
    n, v = int(total), int(distinct)
    discount = (single + 0.1) / (v + 1)

    replies = one.where("block IS NOT NULL").withColumn("kind", F.lit(1)).unionByName(two.where("block IS NOT NULL").withColumn("kind", F.lit(2)))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "array<long>"), ("held", "array<boolean>"), ("tokens", "array<int>"), ("vocabulary", "binary"), ("places", "binary"))]
    replies = replies.select("block", "kind", "bucket", "width", "answer", *empty)
    own = table.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(0).alias("width"), F.lit(None).cast("binary").alias("answer"),
                       "doc_id", "held", "tokens", "vocabulary", "places")

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        (mine,) = np.flatnonzero(kind == 0)
        doc, held = group.column("doc_id")[mine].values, group.column("held")[mine].values
        block = Block(*(group.column(c)[mine] for c in ("held", "tokens", "vocabulary", "places")))

        def counts(order):
            keys, _, of = block.requests(order)
            bucket, out = (keys % np.uint64(buckets)).astype(np.int64), np.empty(len(keys), dtype=np.float64)
            by = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for r in np.flatnonzero(kind == order):
                b = group.column("bucket")[r].as_py()
                out[by[at[b]: at[b + 1]]] = _counts(group.column("answer")[r], group.column("width")[r].as_py())
            return out, of

        word, place = counts(1)
        arc, of = counts(2)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        unigram = np.where(word > 0, (word - discount) / max(n, 1), discount * v / n if n else 1.0)
        ends = np.uint64(_END)
        texts = word[np.searchsorted(block.vocabulary, ends)]
        state = np.append(word, texts)  # how often a history was left; the start once for each training text
        history = block.histories()
        # a seen arc, or the failure arc and the unigram's arc
        step = np.where(arc[of] > 0, np.log10((arc[of] + prior * unigram[place]) / (state[history] + prior)),
                        np.log10(prior / (state[history] + prior)) + np.log10(unigram[place]))
        m = len(block.tokens)
        return pa.table({
            "doc_id": doc, "held_out": held, "n_tokens": pa.array(block.tokens.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64)[place], block.first)), "train_tokens": pa.array(np.full(m, n, np.int64)),
            "base_score": pa.array(np.add.reduceat(base[place], block.first)), "score": pa.array(np.add.reduceat(step, block.first))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.unionByName(replies).groupBy("block").applyInArrow(run, schema)
