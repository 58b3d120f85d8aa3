"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Each class has its own highest order: counts of a byte after the five before it (words are padded by spaces). All
lower orders are shared: their counts are numbers of distinct longer n-grams in either class. So an expression
that one class has seen too rarely is judged alike by both, and only what sets the classes apart remains in
log P(word | toxic) - log P(word | ordinary).

A text is described by this difference per byte over the whole text, and by its largest differences per word, divided
by length too; a logistic function fitted on rows the models have not seen turns them into a score.

Labels come from at most about ``SAMPLE`` rows, chosen by a hash of the doc_id, and only from those the caller calls
known: three quarters of them fit the n-grams, a quarter the logistic function. Texts are learned whole. The table of
n-grams, which is collected and broadcast, holds at most ``GRAMS`` entries of 24 bytes: where the sample has more, half of
it is learned from, then a quarter, and so on. Only three numbers a row reach the driver for the logistic function.

Defined results: a label teaches one text of its doc_id, the first in order; null or blank text has no words and gets the score of a text without evidence; labels that are null,
repeated against each other or without a document are left out; without labels of both classes the score is the share of
toxic labels (0 if there are none); repeated rows and a null doc_id are scored like others; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tendermill.llm import words
from tendermill.llm.store import checkpointed, small_side

SAMPLE = 24_000
#: N-grams that the driver and each worker hold at most.
GRAMS = 4_000_000
ORDER, DISCOUNT = 6, 0.9
#: Features of a text.
FEATURES = 3
_DISTINCT = 1 << 20
_HALVINGS = 24


def padded_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``ORDER`` bytes up to each byte of each word (and of the space after it), and the word each belongs to."""
    length = ends - starts
    spaced = length + ORDER
    flat = np.full(int(spaced.sum()), 32, dtype=np.uint64)
    begin = np.cumsum(spaced) - spaced
    flat[words.gather(begin + ORDER - 1, length)] = words.LOWER[data[words.gather(starts, length)]]
    at = words.gather(begin + ORDER - 1, length + 1)
    gram = np.zeros(len(at), dtype=np.uint64)
    for back in range(ORDER):
        gram |= flat[at - back] << np.uint64(8 * back)
    return gram, np.repeat(np.arange(len(length)), length + 1)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) from (text, toxic)."""

    def run(batches):
        held, size = [], 0

        def folded():
            gram, toxic, ordinary = (np.concatenate(x) for x in zip(*held))
            distinct, inverse = np.unique(gram, return_inverse=True)
            sums = [np.bincount(inverse, x, len(distinct)).astype(np.int64) for x in (toxic, ordinary)]
            return distinct, *sums

        def batch_of(distinct, toxic, ordinary):
            return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(toxic), pa.array(ordinary)], names=["gram", "toxic", "ordinary"])

        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in words.pieces(batch.column(0)):
                starts, ends, upto = words.spans(data, offsets)
                gram, word = padded_grams(data, starts, ends)
                toxic = np.repeat(label[first: first + len(offsets) - 1], np.diff(upto))[word] == 1
                held.append((gram, toxic.astype(np.int64), (~toxic).astype(np.int64)))
                held[:] = [folded()]
                size = len(held[0][0])
                if size > _DISTINCT:
                    yield batch_of(*held[0])
                    held.clear()
        if held:
            yield batch_of(*held[0])

    return texts.mapInArrow(run, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _by_context(gram: np.ndarray, count: np.ndarray):
    """For sorted grams: totals and numbers of followers of their contexts, for each gram."""
    context = gram >> np.uint64(8)
    at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    size = np.diff(np.append(at, len(context)))
    return context[at], np.add.reduceat(count, at), np.add.reduceat((count > 0).astype(np.float64), at), np.repeat(np.arange(len(at)), size)


def shared_probability(gram: np.ndarray) -> np.ndarray:
    """P(byte | the ORDER - 2 bytes before it) for sorted distinct grams, from continuation counts of both classes."""
    kept = [gram]
    for k in range(ORDER - 1, 0, -1):
        kept.append(np.unique(kept[-1] & _low(k)))
    p = np.full(1, 1 / 257)
    shorter = np.zeros(1, dtype=np.uint64)
    for k in range(1, ORDER):
        own, longer = kept[ORDER - k], kept[ORDER - k - 1]
        count = np.bincount(np.searchsorted(own, longer & _low(k)), minlength=len(own)).astype(np.float64)
        _, total, kinds, of = _by_context(own, count)
        rest = p[np.searchsorted(shorter, own & _low(k - 1))]
        p, shorter = np.maximum(count - DISCOUNT, 0) / total[of] + DISCOUNT * kinds[of] / total[of] * rest, own
    return p[np.searchsorted(shorter, gram & _low(ORDER - 1))]


def _low(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


class Ratio:
    """log P(byte | toxic) - log P(byte | ordinary) for every n-gram."""

    def __init__(self, gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> None:
        by = np.argsort(gram)
        self.gram = gram[by]
        shared, value, lost = shared_probability(self.gram), 0.0, 0.0
        for sign, count in ((1, toxic[by].astype(np.float64)), (-1, ordinary[by].astype(np.float64))):
            self.context, total, kinds, of = _by_context(self.gram, count)
            seen = total > 0
            back = np.where(seen, DISCOUNT * kinds / np.where(seen, total, 1), 1.0)
            own = np.maximum(count - DISCOUNT, 0) / np.where(seen, total, 1)[of]
            value = value + sign * np.log(own + back[of] * shared)
            lost = lost + sign * np.log(back)
        self.value, self.lost = value, lost

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        gram, word = padded_grams(data, starts, ends)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        known = self.gram[at] == gram
        value = np.where(known, self.value[at], 0.0)
        context = gram[~known] >> np.uint64(8)
        to = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        value[~known] = np.where(self.context[to] == context, self.lost[to], 0.0)
        return np.bincount(word, value, len(starts))


def described(docs: DataFrame, shared) -> DataFrame:
    """The features of each row of (doc_id, text), and its further columns."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        ratio, hasher, memo = shared.value, words.Hasher(), words.Memo()
        value, size = np.zeros(0), np.zeros(0)
        for batch in batches:
            rows = [np.zeros((0, FEATURES))]
            for _, data, offsets in words.pieces(batch.column(1)):
                if memo.full:
                    memo.clear()
                    value, size = value[:0], size[:0]
                data = words.LOWER[data]
                starts, ends, upto = words.spans(data, offsets)
                number, new = memo.see(hasher.ranges(data, starts, ends))
                value = np.concatenate((value, ratio.of_words(data, starts[new], ends[new])))
                size = np.concatenate((size, (ends - starts)[new] + 1.0))
                v, n = value[number], size[number]
                out = np.zeros((len(offsets) - 1, FEATURES))
                full = np.flatnonzero(np.diff(upto))
                if len(full):
                    at = upto[:-1][full]
                    out[full, 0] = np.add.reduceat(v, at) / np.add.reduceat(n, at)
                    out[full, 1] = np.maximum.reduceat(v, at)
                    out[full, 2] = np.maximum.reduceat(v / n, at)
                rows.append(out)
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(rows[:, k]) for k in range(FEATURES))],
                                             names=[*names, *(f"f{k}" for k in range(FEATURES))])
        memo.clear()
        value = size = None
        words.give_back()

    names = [f.name for f in kept]
    return docs.mapInArrow(run, StructType([*kept, *(StructField(f"f{k}", DoubleType()) for k in range(FEATURES))]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and intercept of least mean log loss by Newton's steps; the ridge counts in units of each column's deviation."""
    scale = np.where((sd := x.std(axis=0, ddof=1)) > 0, sd, 1.0)
    z = np.column_stack((x / scale, np.ones(len(x))))
    weight, pull = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weight, -500, 500)))
        slope = z.T @ (p - y) / len(y) + pull * weight
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(pull + 1e-12)
        step = np.linalg.solve(curve, slope)
        longest = np.abs(step).max()
        weight -= step * min(1.0, 5.0 / max(longest, 1e-300))
        if longest < 1e-10:
            break
    return weight / np.append(scale, 1.0)


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, known, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
             least: float = 0.3, whole: bool = False, grams: int = GRAMS) -> DataFrame:
    """(doc_id, score, predicted) for every row; with ``whole`` also ``row``, all its columns.

    ``known`` tells from a doc_id column whether its label may be learned.
    """
    context = docs.sparkSession.sparkContext
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *row)
    kept = ["doc_id", *docs.columns[2:]]
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & known(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    share = min(1.0, sample / max(1, labels.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    labels = checkpointed(labels.where(draw < int(share * (1 << 20))).withColumn("half", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(4)) == 1).cast("int")))
    labelled = docs.join(small_side(labels), "doc_id").groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text"))
    labelled = checkpointed(labelled.select("doc_id", "text", "toxic", "half"))
    for part in range(_HALVINGS):
        learned = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1 << part)) == 0)
        rows = {(r["half"], r["toxic"]): r["count"] for r in learned.groupBy("half", "toxic").count().collect()}
        table = checkpointed(gram_counts(learned.where("half = 0").select("text", "toxic")))
        if table.count() <= grams:
            break
    found = table.toArrow()
    if len(rows) < 4 or not found.num_rows:
        toxic = sum(n for (_, t), n in rows.items() if t)
        constant = toxic / max(1, sum(rows.values()))
        return docs.select(*kept, F.lit(constant).alias("score"), F.lit(int(constant >= least)).alias("predicted"))
    gram, toxic, ordinary = (found.column(c).to_numpy() for c in ("gram", "toxic", "ordinary"))
    del found
    ratio = context.broadcast(Ratio(gram.view(np.uint64), toxic, ordinary))
    fitted = described(learned.where("half = 1").select("doc_id", "text", "toxic"), ratio)
    # a row of numbers for each labelled document of the sample, at most SAMPLE of them
    fitted = fitted.select(*(f"f{k}" for k in range(FEATURES)), F.col("toxic").cast("double").alias("label")).toArrow()
    columns = [c.to_numpy() for c in fitted.columns]
    *weights, intercept = logistic(np.column_stack(columns[:-1]), columns[-1]).tolist()
    z = F.lit(intercept)
    for k, weight in enumerate(weights):
        z = z + F.lit(weight) * F.col(f"f{k}")
    scored = described(docs, ratio).select(*kept, (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
