"""Operators on texts against brute force, with the odd rows every operator must bear."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendermill.llm import exact, jaccard, lines, mixing, packing, scoring, tokens, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgé"), draw.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, blanks, ties, repeated rows, long and near texts, groups of copies, a shared passage."""
    base, passage = prose(1, 120), prose(2, 60)
    words = base.split(" ")
    rows = [(1, base, "en", "b", 1), (2, base, "en", "b", 1), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \t\n ", "en", "a", 4),
            (6, "one two", "en", "a", 7), (7, "One  TWO", "en", "c", 8), (8, "a b c d e", "en", "c", 9), (None, base, "en", "c", 1), (9, "a b c d e f", "en", "c", 11),
            (10, "tie", "en", "b", 3), (10, "tie", "en", "b", 3), (11, "t ie", "en", "b", 4), (12, prose(3, 6000), "de", "d", 9), (13, "end\\", "en", "d", 4)]
    for k in range(80):
        edited = list(words)
        for place in np.random.default_rng(k).choice(120, k % 5, replace=False):
            edited[place] = f"x{k}y{place}"
        rows.append((100 + k, " ".join(edited), "en", "b", 1))
    for k in range(70):
        rows.append((300 + k, prose(500 + k, 40) + "\n" + passage + "\n" + prose(700 + k, 30), "en", "a", 1))
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5).withColumn("n", F.lit(1)).withColumn("key", F.lit("x")).withColumn("kind", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size=5):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i: i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_jaccard(odd, odd_rows, empty):
    sets = [(d, shingles(t)) for d, t, *_ in odd_rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [x for x in sets if x[0] is not None]
    for i, (d, a) in enumerate(named):
        for e, b in named[:i]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    want = sorted((str(d), len(s), None if d is None else find(d)) for d, s in sets)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard(odd).collect())
    assert got == want
    assert jaccard.ngram_jaccard(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {x for x in parent if parent[x] == x} | {None}


def test_jaccard_boundary_by_cost():
    sizes = {n: 100 for n in range(2, 60)}
    cheap, dear = jaccard.boundary(sizes, 1.0, 80), jaccard.boundary(sizes, 30.0, 80)
    assert cheap < dear
    assert jaccard.boundary({}, 1.0, 80) == 1


def test_exact(odd, odd_rows, empty):
    plain = [(d, t or "", re.sub("[\x20\x09-\x0d]", "", t or "")) for d, t, *_ in odd_rows]
    groups = collections.defaultdict(list)
    for d, t, c in plain:
        groups[c].append((-len(t), d is None, d or 0))
    got = exact.exact_dedup(odd).collect()
    assert len(got) == len(odd_rows)
    assert sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(c.encode()).hexdigest(): sorted(g) for c, g in groups.items()}
    for r in got:
        g = by_hash[r.text_sha256]
        assert r.group_size == len(g)
        assert r.keep_id == (None if g[0][1] else g[0][2])
        assert not r.kept or r.doc_id == r.keep_id
    assert exact.exact_dedup(empty).count() == 0


def test_line_dedup(odd, odd_rows, empty):
    def brute(rows, least):
        seen, out = set(), {}
        for d, t in rows:
            q = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)] if t is not None else []
            gone = set()
            for i in range(len(q)):
                n = 0
                for j in range(i, len(q)):
                    n += len(WORD.findall(q[j][1]))
                    run = tuple(x for _, x in q[i: j + 1])
                    if n >= least and run in seen:
                        gone |= {k for k, _ in q[i: j + 1]}
                    elif n >= least:
                        seen.add(run)
            out[d, t] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        return out

    more = [(900 + k, "\n".join(["aa bb", "cc dd ee", "", f"u{k} v{k}", "aa bb", "cc dd ee", "ff"][k % 4:] * (1 + k % 2)), "en", "a", 1) for k in range(12)]
    rows = sorted({(d, t) for d, t, *_ in odd_rows + more}, key=lambda x: (x[0] is None, x[0] or 0, str(x[1])))
    table = odd.unionByName(odd.sparkSession.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    for least in (4, 25):
        got = lines.line_dedup(table, min_words=least).collect()
        want = brute(rows, least)
        source = {(d, t) for d, t, *_ in odd_rows + more}
        assert collections.Counter((r.doc_id, r.text) for r in got if r.doc_id != 10 and r.doc_id is not None) == collections.Counter(
            (d, want[d, t]) for d, t in source if d != 10 and d is not None)
        assert len(got) == len(odd_rows) + len(more)
    assert lines.line_dedup(empty).count() == 0


def test_mixing(odd, odd_rows, empty):
    got = mixing.pareto_mix(odd).collect()
    assert len(got) == len(odd_rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.pareto_mix(odd.repartition(3)).collect()), key=str)
    size = collections.Counter()
    for _, t, _, source, _ in odd_rows:
        size[source] += len(WORD.findall(t or ""))
    for source in size:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size[source]}
        target = own[0].target
        assert target <= 2 * size[source] + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-9
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    targets = {r.source: r.target for r in got}
    assert math.isclose(sum(targets.values()), 1.5 * sum(size.values()))
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns
    assert mixing.pareto_mix(empty).count() == 0


def test_packing(odd, odd_rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t, *_ in odd_rows)
    pieces = packing.pack(odd, length=64, keep_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, dtype="<u4")) == p.ids_crc32 and len(p.ids) == p.length > 0
        by_sequence[p.sequence_id].append(p)
    stream = []
    for s in sorted(by_sequence):
        own = sorted(by_sequence[s], key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) == 64 or s == max(by_sequence)
        stream += own
    whole, text = collections.Counter(), []
    for p in stream:
        assert p.start == len(text)
        text += p.ids
        if len(text) == p.doc_tokens:
            whole[tuple(text)] += 1
            text = []
    assert whole == ids and not text
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n  　\u0085abcé'ss1٣,!?<|endoftext|>漢🙂\r")), max_size=40), min_size=1, max_size=4))
def test_parts_encode_like_whole_texts(texts):
    import public_tokenizers
    import pyarrow as pa

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder.texts(pa.array(texts, pa.string()))):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(odd, odd_rows, empty):
    import public_tokenizers

    vocabulary = set(tokens.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    longest = max(map(len, vocabulary))

    def pieces(word):
        n = at = 0
        while at < len(word):
            at += next(m for m in range(min(longest, len(word) - at), 0, -1) if word[at: at + m] in vocabulary)
            n += 1
        return n

    want = collections.Counter((d, len(w), sum(pieces(b" " + x.encode()) for x in w)) for d, w in ((d, WORD.findall(t or "")) for d, t, *_ in odd_rows))
    assert collections.Counter(map(tuple, tokens.token_counts(odd).collect())) == want
    assert tokens.token_counts(empty).count() == 0


def test_lm_scores(odd, odd_rows, empty):
    prior, counts, pairs = scoring.PRIOR, collections.Counter(), collections.Counter()
    texts = [(d, WORD.findall(lowered(t)) + ["</end>"], d is not None and zlib.crc32(str(d).encode()) % 10 == 0) for d, t, *_ in odd_rows]
    for _, w, held in texts:
        if not held:
            counts.update(w)
            pairs.update(zip(["<start>"] + w, w))
    n, v = sum(counts.values()), len(counts)
    discount = (sum(c == 1 for c in counts.values()) + 0.1) / (v + 1)
    left = counts | {"<start>": counts["</end>"]}

    def unigram(x):
        return (counts[x] - discount) / n if counts[x] else discount * v / n

    want = []
    for d, w, held in texts:
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10((pairs[h, x] + prior * unigram(x)) / (left.get(h, 0) + prior)) for h, x in zip(["<start>"] + w, w))
        want.append((str(d), held, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = scoring.lm_scores(odd, lambda d: toxicity.fold(d, 10) == 0).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == sorted(want)
    # the automaton's probabilities of all words after a history sum to one
    total = sum((pairs["<start>", x] + prior * unigram(x)) / (left["<start>"] + prior) for x in counts) + prior * discount * v / n / (left["<start>"] + prior)
    assert math.isclose(total, 1)
    assert scoring.lm_scores(empty, lambda d: toxicity.fold(d, 10) == 0).count() == 0
    assert scoring.lm_scores(odd, lambda d: d.isNotNull() | F.lit(True)).count() == len(odd_rows)


def test_toxicity(spark, odd, empty):
    bad = ["zorgle", "quexif"]
    rows, labels = [], []
    for k in range(400):
        text, toxic = prose(k, 30), int(k % 5 == 0)
        rows.append((k, text + (f" {bad[k % 2]} {bad[k % 2]}s" if toxic else ""), "en", "a", 1))
        labels.append((k, 1, toxic))
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels + [(1, 1, 1), (2, None, None), (None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    known = lambda d: toxicity.fold(d, 4) != 2
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table, known).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum(got[k].predicted == labels[k][2] for k in held) / len(held)
    assert right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(odd, table, known).count() == odd.count()
    assert toxicity.toxicity(empty, table, known).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, table.where("toxic = 0"), known).collect()} == {0.0}
