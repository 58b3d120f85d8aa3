"""Secret scans by one combined deterministic automaton.

The regular expressions of all rules are compiled into a single minimal automaton that searches for all of them at once
(:mod:`automata`): one step for each byte of a text, whatever the number of rules. Its states say where some rule's
match ends and where nothing is open. Between two idle places lies a region; no match reaches beyond it. In a region in
which a rule ends, an automaton of the reversed rule marks where its matches begin, and the rule's own automaton
follows each to its longest end: leftmost matches that do not overlap, for each rule by itself.

A rule has a head and a value; a match counts when its value has at least ``least`` characters. Matches that fail still
take their place, as in a scan that filters afterwards.

Texts are cut into lanes that step together, and long ones into blocks, so memory does not grow with a text.

Defined results: null text counts as empty and has no spans; places are code points, ends exclusive; repeated rows and a
null doc_id come back as they are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.automata import SEPARATOR, Automaton, Searcher


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    value: str
    least: int = 1


# The base rules, then two forms of keys that are publicly documented.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "", r"[0-9a-f]{24,}"),  # a run of hex digits matches as a whole or not at all
)
FURTHER = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("keyblock", "", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
)


class _Small:
    """An automaton of one rule as lists, for the few bytes of a region."""

    def __init__(self, automaton: Automaton) -> None:
        self.step, self.kind, self.dead = automaton.step.tolist(), automaton.kind.tolist(), automaton.dead
        self.ends = np.repeat(automaton.accepts != 0, automaton.width).tolist()

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that begins at ``at``; ``at`` itself for an empty or no match."""
        state, end = 0, at
        for k in range(at, len(data)):
            state = self.step[state + self.kind[data[k]]]
            if state == self.dead:
                break
            if self.ends[state]:
                end = k + 1
        return end

    def ends_before(self, data: bytes) -> list[int]:
        """For a reversed pattern: the places from which it matches forward, in order."""
        state, found = 0, []
        for k in range(len(data) - 1, -1, -1):
            state = self.step[state + self.kind[data[k]]]
            if self.ends[state]:
                found.append(k)
        return found[::-1]


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        whole = [r.head + r.value for r in rules]
        self.search = Automaton(whole, search=True)
        self.begins = [_Small(Automaton([p], search=True, backward=True)) for p in whole]
        self.follows = [_Small(Automaton([p], search=False)) for p in whole]
        self.heads = [_Small(Automaton([r.head], search=False)) for r in rules]

    def matches(self, k: int, data: bytes):
        """(start, end) of rule ``k`` in a region."""
        upto = 0
        for start in self.begins[k].ends_before(data):
            if start < upto:
                continue
            upto = self.follows[k].longest(data, start)
            value = self.heads[k].longest(data, start)
            if upto - value >= self.rules[k].least:
                yield start, upto

    def texts(self, data: np.ndarray, offsets: np.ndarray, searcher: Searcher) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with spans its (start, rule, end) in code points, in order."""
        joined = np.insert(data, offsets[:-1], SEPARATOR)
        before = offsets[:-1] + np.arange(len(offsets) - 1)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, bits in searcher.regions(joined):
            text = int(np.searchsorted(before, start, side="right")) - 1
            shift = start - int(before[text]) - 1
            region = joined[start:end].tobytes()
            for k in range(len(self.rules)):
                if bits >> k & 1:
                    found.setdefault(text, []).extend((a + shift, k, b + shift) for a, b in self.matches(k, region))
        return {t: _in_code_points(data[offsets[t]: offsets[t + 1]], spans) for t, spans in found.items() if spans}


def _in_code_points(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    place, seen, last = {}, 0, 0
    for at in sorted({p for a, _, b in spans for p in (a, b)}):
        seen += int(np.count_nonzero((text[last:at] & 0xC0) != 0x80))
        place[at], last = seen, at
    return sorted((place[a], k, place[b]) for a, k, b in spans)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + FURTHER) -> DataFrame:
    """(doc_id, spans) for every row: the kind, start and end of each match, by start and then in the order of the rules."""
    scanner = Scanner(rules)  # a few hundred states, whatever the data
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        searcher = Searcher(scanner.search)
        for batch in batches:
            spans: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for first, data, offsets in words.pieces(batch.column(1)):
                for t, own in scanner.texts(data, offsets, searcher).items():
                    spans[first + t] = [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def summary(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc_id, n_ and the kind of each base rule, base_sha256, spans as text) from the spans of each document."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    of_base = listed(of(*(r.kind for r in base)))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(of_base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
