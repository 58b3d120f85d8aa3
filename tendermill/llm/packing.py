"""Packing token ids into sequences of a fixed length: concatenate and cut.

1. Every text is turned into ids (null counts as empty) and ends with ``end_id``. A row is kept with its task's
   number and its place among the task's ids, and the table is written.
2. Running sums of the tasks' totals (one row a task) give each text its place in one long sequence, which is cut
   every ``length`` ids. A text across a cut gets a piece on either side.

Only the last sequence is short. It is padded to ``length`` when it is used, unless its size is a power of two.

White space after something else always starts a new token of a byte-level BPE, so a text falls into parts of white
space and what follows it. Each task encodes a part once and looks it up afterwards; ids equal those of whole texts.
The tokenizer is used as loaded: a text that holds ``<|endoftext|>`` gets its one id there.

Defined results: an empty text is the end id alone; rows that repeat a doc_id are documents of their own; a null
doc_id stays null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.store import stored

#: Last two bytes of the white space beyond ASCII, as UTF-8; a superset, which only makes some parts longer.
_BLANK_LAST = [0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]
_BLANK_BEFORE = [0xC2, 0x9A, 0x80, 0x81]


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts, for each text the number of parts before it, and which parts are plain.

    A plain part begins with white space and ends with something else: one after the other they stay parts of their own.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64), none == 0
    last, before = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    last[_BLANK_LAST], before[_BLANK_BEFORE] = True, True
    blank = words.SPACE[data]
    maybe = blank.copy()
    maybe[1:] |= last[data[1:]] & before[data[:-1]]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = blank[1:] & ~maybe[:-1]
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets), blank[starts] & ~maybe[ends - 1]


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or any(x.isspace() for x in token.content):
                raise ValueError("added tokens must not take white space")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one letter a byte
        self.hasher, self.memo = words.Hasher(), words.Memo(1_000_000)
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """Add the ids of new parts. Plain parts are encoded many at a time, and told apart by the bytes of their ids."""
        size, length = ends - starts, np.zeros(len(starts), dtype=np.int64)
        one = np.flatnonzero(plain)
        groups = [one[k: k + 4096] for k in range(0, len(one), 4096)] + [np.array([k]) for k in np.flatnonzero(~plain)]
        found, at = [], [(starts[g].tolist(), ends[g].tolist()) for g in groups]
        for k in range(0, len(groups), 16):
            texts = [b"".join(raw[a:b] for a, b in zip(*x)).decode("utf-8") for x in at[k: k + 16]]
            for group, e in zip(groups[k: k + 16], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype=np.uint32)
                upto, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(size[group])
                last = np.searchsorted(upto, wanted)
                if last[-1] != len(ids) - 1 or (upto[last] != wanted).any():
                    raise ValueError("the tokenizer must keep every byte, and start a token at white space")
                length[group] = np.diff(last, prepend=-1)
                found.append(ids)
        order = np.concatenate(groups) if groups else one
        start = np.empty_like(length)
        start[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        self.start, self.length = np.concatenate((self.start, start)), np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, *found))

    def texts(self, column: pa.Array):
        """The ids of every text, in order."""
        for _, data, offsets in words.pieces(column):
            if self.memo.full:
                self.clear()
            starts, ends, upto, plain = parts(data, offsets)
            number, new = self.memo.see(self.hasher.ranges(data, starts, ends))
            self._learn(data.tobytes(), starts[new], ends[new], plain[new])
            many = self.length[number]
            ids = self.ids[words.gather(self.start[number], many)]
            at = np.concatenate(([0], np.cumsum(many)))[upto]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield ids[a:b]


def encoded(docs: DataFrame, end_id: int, path: str | None) -> DataFrame:
    """(task, start, tokens, doc_id, ids): ``start`` counts the task's ids before the text; ids are 16 bits wide where the vocabulary allows."""

    def run(batches):
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words.give_back()  # what earlier stages left in this worker
        encoder = Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        words.give_back()  # what reading the vocabulary took
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        width, before = (np.uint16 if narrow else np.uint32), 0
        task = TaskContext.get().partitionId()

        def rows(doc_id, n, blobs, first):
            n = np.array(n, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), task, np.int32)), pa.array(first + np.cumsum(n) - n), pa.array(n), doc_id,
                 pa.array(np.full(len(n), np.dtype(width).itemsize, np.int32)), pa.array(blobs, pa.binary())],
                names=["task", "start", "tokens", "doc_id", "width", "ids"])

        for batch in batches:
            n, blobs, held, done = [], [], 0, 0
            for ids in encoder.texts(batch.column(1)):
                blobs.append(np.append(ids.astype(width), width(end_id)).tobytes())
                n.append(len(ids) + 1)
                held += len(blobs[-1])
                if held > 8 << 20:
                    yield rows(batch.column(0).slice(done, len(n)), n, blobs, before)
                    before, done = before + sum(n), done + len(n)
                    n, blobs, held = [], [], 0
            if n:
                yield rows(batch.column(0).slice(done, len(n)), n, blobs, before)
                before += sum(n)
        encoder = None
        words.give_back()

    return docs.mapInArrow(run, "task int, start long, tokens long, doc_id long, width int, ids binary")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, path: str | None = None,
         keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``keep_ids`` also their ids."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = stored(encoded(docs, end_id, path), "zstd")
    totals = table.groupBy("task").agg(F.sum("tokens").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that wrote the table
    place = F.broadcast(totals.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    placed = table.join(place, "task").select("doc_id", "tokens", (F.col("before") + F.col("start")).alias("at"), "width", "ids")

    def run(batches):
        for batch in batches:
            tokens, at, width = (batch.column(c).to_numpy() for c in (1, 2, 3))
            first = at // length
            many = (at + tokens - 1) // length - first + 1
            row = np.repeat(np.arange(len(at)), many)
            sequence = words.gather(first, many)
            begin = np.maximum(sequence * length - at[row], 0)
            end = np.minimum((sequence + 1) * length - at[row], tokens[row])
            ids, crc, kept = batch.column(4), [], []
            for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
                w = int(width[r])
                own = np.frombuffer(ids[r].as_buffer(), dtype=np.uint16 if w == 2 else np.uint32)[a:b].astype("<u4")
                crc.append(zlib.crc32(own))
                if keep_ids:
                    kept.append(own.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row)), pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(tokens[row]),
                       pa.array(sequence), pa.array(np.where(begin > 0, 0, at[row] - sequence * length))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
