"""Token counts by greedy longest match, in one pass over each word.

The vocabulary becomes a trie. Every node knows where matching goes on when the next byte does not fit (its failure
link) and how many pieces are settled by then, so a word's pieces are counted without building or rescanning them.
A word is a run of bytes other than space and 0x09-0x0D; it is matched with a space before it, as the vocabulary
spells words. All single bytes are in the vocabulary, so matching never fails.

Each task matches a distinct word once, all words in step, and looks it up afterwards.

Defined results: null or blank text has no words and no tokens; repeated rows and a null doc_id come back as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm import words


def spelled_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    byte = spelled_bytes()
    return [bytes(byte[c] for c in token) for token in model["model"]["vocab"] if token not in special]


class Automaton:
    """Trie with failure links and counts of settled pieces."""

    def __init__(self, pieces: list[bytes]) -> None:
        child, is_piece = [{}], [False]
        for piece in pieces:
            at = 0
            for b in piece:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    is_piece.append(False)
                at = child[at][b]
            is_piece[at] = True
        if any(b not in child[0] or not is_piece[child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        fail, settled, order = [0] * len(child), [0] * len(child), [0]
        for v in order:
            for b, w in child[v].items():
                order.append(w)
                if is_piece[w]:
                    settled[w] = 1
                    continue
                z, n = fail[v], settled[v]
                while b not in child[z]:
                    n += settled[z]
                    z = fail[z]
                fail[w], settled[w] = child[z][b], n
        edge = np.array([v * 256 + b for v in range(len(child)) for b in child[v]], dtype=np.int64)
        to = np.array([w for v in range(len(child)) for w in child[v].values()], dtype=np.int64)
        by = np.argsort(edge)
        self.edge, self.to = edge[by], to[by]
        self.fail, self.settled = np.array(fail, dtype=np.int64), np.array(settled, dtype=np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word, all words taking their next byte together."""
        state = self._next(np.zeros(len(starts), np.int64), np.full(len(starts), 32), count := np.zeros(len(starts), np.int64))
        length = ends - starts
        by = np.argsort(-length, kind="stable")
        starts, state, count = starts[by], state[by], count[by]
        active = np.searchsorted(-length[by], -np.arange(length.max(initial=0)), side="left")
        for step, m in enumerate(active.tolist()):
            state[:m] = self._next(state[:m], data[starts[:m] + step].astype(np.int64), count[:m])
        while (left := state > 0).any():
            count[left] += self.settled[state[left]]
            state[left] = self.fail[state[left]]
        out = np.empty_like(count)
        out[by] = count
        return out

    def _next(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        state, out, open_ = state.copy(), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            key = state[open_] * 256 + byte[open_]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            fits = self.edge[at] == key
            out[open_[fits]] = self.to[at[fits]]
            open_ = open_[~fits]
            count[open_] += self.settled[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    # bounded by the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(path)))

    def run(batches):
        automaton, hasher, memo, pieces = shared.value, words.Hasher(), words.Memo(), np.zeros(0, np.int64)
        for batch in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, offsets in words.pieces(batch.column(1)):
                if memo.full:
                    memo.clear()
                    pieces = pieces[:0]
                starts, ends, upto = words.spans(data, offsets)
                number, new = memo.see(hasher.ranges(data, starts, ends))
                pieces = np.concatenate((pieces, automaton.counts(data, starts[new], ends[new])))
                n_words.append(np.diff(upto))
                n_tokens.append(np.diff(np.concatenate(([0], np.cumsum(pieces[number])))[upto]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))],
                                             names=["doc_id", "n_words", "n_tokens"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
