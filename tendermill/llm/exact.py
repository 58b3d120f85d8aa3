"""Exact deduplication of texts without spaces, safe for groups of any size.

Texts are equal when identical without the characters 0x20 and 0x09-0x0D (null counts as empty).

1. Each task folds its own copies: a text is compared in full with the first one of its digest.
2. First texts whose digest other tasks have too meet by (digest, salt) and are compared in full.
3. What the salts keep meets by digest, and is compared in full again. A digest with more than one
   content (a collision) gets a variant for each.

Winners are found the same way: in the task, by (digest, variant, salt), by (digest, variant). So a text in a
third of all rows costs each task one row.

Defined results: of equal texts the row with the most code points in the original text stays, then the smallest
doc_id (null last), then one of the repeated rows; every row comes back; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.store import checkpointed, small_side, stored

BLANKS = bytes([32, 9, 10, 11, 12, 13])
#: Bytes of text that a task holds for comparison.
HELD = 64 << 20
SALTS = 16


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, sha, first): ``first`` marks a text that its task has not met before."""

    def run(batches):
        met, held = {}, 0
        for batch in batches:
            n_points, sha, first = [], [], []
            for _, data, at in words.pieces(batch.column(1)):
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                n_points += np.diff(points[at]).tolist()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    content = data[a:b].tobytes().translate(None, BLANKS)
                    digest = hashlib.sha256(content).hexdigest()
                    known = met.get(digest)
                    if known is None:
                        if held > HELD:
                            met.clear()
                            held = 0
                        met[digest] = content
                        held += len(content)
                    sha.append(digest)
                    first.append(known is None or known != content)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_points, pa.int64()), pa.array(sha, pa.string()), pa.array(first, pa.bool_())],
                names=["doc_id", "n_points", "sha", "first"])

    return docs.mapInArrow(run, "doc_id long, n_points long, sha string, first boolean")


def _content(docs: DataFrame):
    blank = "".join(map(chr, BLANKS))
    return docs.withColumn("content", F.translate(F.coalesce("text", F.lit("")), blank, ""))


def variants(docs: DataFrame, each: DataFrame) -> DataFrame | None:
    """(sha, content, variant) of digests with several contents; None if there are none."""
    shared = each.where("first").groupBy("sha").agg(F.count("*").alias("met")).where("met > 1").select("sha")
    wanted = checkpointed(each.where("first").join(shared, "sha", "left_semi").select("doc_id", "sha").distinct())
    texts = _content(docs).join(small_side(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.select(F.sha2("content", 256).alias("sha"), "content", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    salted = texts.groupBy("sha", "salt", "content").agg(F.count("*").alias("n"))
    merged = salted.groupBy("sha", "content").agg(F.sum("n").alias("n"))
    several = checkpointed(merged.groupBy("sha").agg(F.count("*").alias("contents")).where("contents > 1").select("sha"))
    if several.isEmpty():
        return None
    content = merged.join(several, "sha").select("sha", "content")
    return content.withColumn("variant", F.md5("content"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    each = stored(digests(docs))
    apart = variants(docs, each)
    if apart is None:
        each = each.withColumn("variant", F.lit(""))
    else:
        own = _content(docs).withColumn("sha", F.sha2("content", 256)).join(apart, ["sha", "content"]).select("doc_id", "sha", "variant").distinct()
        each = stored(each.join(own, ["doc_id", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(""))))
    each = each.withColumn("row", F.monotonically_increasing_id())
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("early"), (-F.col("row")).alias("row"))
    salted = each.groupBy("sha", "variant", F.pmod(F.col("row"), F.lit(SALTS)).alias("salt")).agg(F.max(order).alias("best"), F.count("*").alias("n"))
    best = salted.groupBy("sha", "variant").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    return each.join(best, ["sha", "variant"]).select(
        "doc_id", (-F.col("best.early")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))
