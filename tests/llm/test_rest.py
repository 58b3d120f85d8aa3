"""Vectors, conversations and the pipeline."""

import collections
import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__
import corpus_pipeline
from tendermill.llm import chat, neighbours


def test_near_vectors(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(700):
        rows.append((k, draw.normal(size=16).tolist(), k % 3))
    for k in range(150):  # a group wider than the beam
        rows.append((1000 + k, (np.array(rows[0][1]) + draw.normal(size=16) * 0.02).tolist(), 0))
    rows += [(2000, rows[1][1], 1), (2001, rows[1][1], 1), (2002, rows[1][1], 2), (2003, rows[1][1], None), (2004, None, 1), (2005, [0.0] * 16, 1), (2006, [], 1),
             (2007, [float("nan")] + [1.0] * 15, 1), (2008, [float("inf")] + [1.0] * 15, 1), (2009, [None] + [1.0] * 15, 1), (2010, [1.0] * 4, 1), (None, rows[1][1], 1),
             (2011, [x * 1e200 for x in rows[2][1]], 2)]
    parent, links = {}, collections.Counter()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    good = [(i, np.array(v), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), y) for i, v, y in good]
    for a, (i, v, y) in enumerate(unit):
        for j, w, z in unit[:a]:
            if y == z and len(v) == len(w) and v @ w >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = neighbours.near_vectors(table).collect()
    assert len(got) == len(rows)
    for r in got:
        root = None if r.vec_id is None else find(r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], root, r.vec_id == root)
    assert neighbours.near_vectors(table.limit(0)).count() == 0


def test_recall_of_graphs():
    draw = np.random.default_rng(9)
    unit = neighbours._unit(draw.normal(size=(3000, 32)))
    graph = neighbours.SmallWorld.built(unit.astype(np.float32), 1)
    found, _ = graph.search(unit[:300].astype(np.float32), 64)
    truth = np.argsort(-(unit[:300] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(f) & set(t)) / 10 for f, t in zip(found, truth)]) >= 0.9


PARTS = st.sampled_from(["[INST] ", " [/INST]", "<s>", "</s>", "<<SYS>>\n", "\n<</SYS>>\n", "<|", "|>", "<|end|>", "\\", "<", "[", "|", " ", "a", "\n"])
TEXTS = st.lists(PARTS, max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), min_size=1, max_size=4))
def test_turns_read_back(turns):
    whole = "".join(chat.rendered(role, text)[0] for role, text in turns)
    at, back = 0, []
    while at < len(whole):
        role, text, _, _, at = chat.parsed(whole, at)
        back.append((role, text))
    assert back == turns


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi\\"), (1, 1, "assistant", "again"), (2, None, None, None), (2, 0, "tool", "<|x|>"),
            (None, 3, "user", "x"), (3, 0, "assistant", ""), (1, 0, "user", "hi\\")]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(empty)).count() == 0


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, tiny))
        assert after.columns == docs.columns
        assert after.count() > 0
        if name != "mixing":
            assert after.select("doc_id").distinct().count() <= before.count()
        before = after
    whole = {r.doc_id for r in before.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, tiny).collect()
    assert {p.doc_id for p in pieces} == whole
    run = corpus_pipeline.run(spark, tiny).collect()
    assert sum(p.length for p in run) == sum(p.length for p in pieces)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
