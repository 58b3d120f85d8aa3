"""Rows that share a doc_id or have none, and texts that hold the tokenizer's own token."""

import collections

import numpy as np

import corpus_pipeline
from tendermill.llm import jaccard, mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefgé"), draw.integers(2, 7))) for _ in range(n))


def test_toxic_rows_go_by_their_text(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = {k: " ".join(rng.choice(["grumk", "zwarg"] if k % 2 else ["mild", "kind"], 12)) for k in range(400)}
    labels = [(k, k % 2) for k in text]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, t, "en", "a", 1) for k, t in text.items()]
    rows += [(None, text[1], "en", "a", 1), (None, text[0], "en", "a", 1), (1, text[2], "en", "odd", 1)]
    kept = corpus_pipeline.without_toxic(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(k, t) for k, t in text.items() if k % 2 == 0] + [(None, text[0]), (1, text[2])])


def test_mix_of_rows_without_ids_meets_its_target(spark):
    for ids in ([None] * 300, [7] * 300):
        rows = [(d, prose(k, 5 + k % 3), "en", "a", 1) for k, d in enumerate(ids)] + [(k, prose(k, 400), "en", "b", 1) for k in range(1000, 1004)]
        docs = spark.createDataFrame(rows, SCHEMA)
        target = mixing.pareto_mix(docs, percent=60).where("source = 'a'").first().target
        words = sum(len(r.text.split(" ")) for r in mixing.mixed(docs, percent=60).where("source = 'a'").collect())
        assert abs(words - target) <= 7 / 2 + 1e-9


def test_rows_without_ids_spread_over_bins(spark):
    u = spark.createDataFrame([(None, prose(k, 5), "en", "a", 1) for k in range(50)], SCHEMA)
    got = u.select(mixing.uniform(u.doc_id, 17, mixing.F.xxhash64("text")).alias("u")).distinct().count()
    assert got == 50


def test_one_row_of_each_group_stays(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (1, a), (5, a), (5, b), (6, c), (None, c)]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (6, c), (None, c)], key=str)


def test_an_id_with_two_texts_keeps_its_links(spark):
    a, b = prose(4, 60), prose(5, 60).split(" ")
    near = [*b[:-1], "zz"]
    rows = [(1, a), (2, a), (2, " ".join(b)), (3, " ".join(near))]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in jaccard.ngram_jaccard(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_the_tokenizer_is_used_as_loaded():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"a{mark}b {mark}\n {mark}{mark}  c", f"{mark}  {mark}é\t", "<|endof text|>", f" x {mark}　{mark} 漢{mark}"]
    texts += [prose(k, 20).replace(" c", f" {mark}").replace("a ", mark + " \n") for k in range(40)]
    for text, ids in zip(texts, packing.Encoder(path).texts(pa.array(texts, pa.string()))):
        assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
