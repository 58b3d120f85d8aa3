"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order and null last, get the given weights in turn. Together they share ``percent`` of
all words; a target stops at ``most`` times its source's words, and the excess is shared again by weight.

A document's expected number of copies is its source's target over its source's words. The whole part is
certain. For the rest, p, documents are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p), and taken in
this order until the words that the target still wants are reached; the document at the edge is taken when that
comes nearer. So the sample has a fixed size in words, off by half a document at most, and documents of different
sources are taken with their own probabilities.

u comes from the doc_id, so reruns agree. Ranks within a source are cut into bins of u: running sums need the bins'
totals and the rows of one bin only, however large a source is.

Defined results: null or blank text has size 0 and is never taken; a null doc_id is a document like others, with a u
from its text; repeated rows are separate documents, each with its own number of copies; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm import words
from tendermill.llm.store import numbered, stored

WEIGHTS = (5, 2, 1)
#: Rows of a bin of a source, on average at most.
BIN = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row, print): words of every text, the last two as they come."""

    def run(batches):
        for batch in batches:
            n = [np.zeros(0, dtype=np.int64)]
            for _, data, at in words.pieces(batch.column(2)):
                n.append(np.diff(words.spans(data, at)[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n)), *batch.columns[3:]],
                                             names=["doc_id", "source", "size", "row", "print"])

    return docs.mapInArrow(run, "doc_id long, source string, size long, row long, print long")


def targets(sized: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target); windows run over the table of sources."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(percent) / 100
    level = (budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    sources = sources.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    free = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("place", "level"))
    sources = sources.withColumn("water", F.min(free).over(everything)["level"])
    return sources.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")).alias("target"))


def uniform(doc_id, seed: int, print):
    """A number in (0, 1) from the doc_id alone, or where that is null from ``print``."""
    named = F.coalesce(doc_id.cast("string"), F.concat_ws("-", F.lit("null"), print.cast("string")))
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), named)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def pareto_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
               percent: int = 150, most: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; ``taken`` counts words, repeats included."""
    return _taken(docs, F.lit(None), doc_id, text, source, weights, percent, most, seed).drop("row")


def _taken(docs: DataFrame, row, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
           percent: int = 150, most: int = 2, seed: int = 17) -> DataFrame:
    """:func:`pareto_mix` with ``row``, which tells rows apart."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"),
                       row.cast("long").alias("row"))
    docs = docs.withColumn("print", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    sized = stored(sizes(docs))
    bins = 1 + sized.count() // BIN
    share = targets(sized, weights, percent, most)
    rows = sized.alias("d").join(share.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    rows = rows.withColumn("u", uniform(F.col("doc_id"), seed, F.col("print"))).withColumn("bin", F.floor(F.col("u") * F.lit(bins)).cast("int"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, odds))
    per_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    here = (F.col("d.bin") == F.col("b.bin")) & F.col("d.source").eqNullSafe(F.col("b.source"))
    rows = rows.alias("d").join(per_bin.alias("b"), here).select("d.*", "b.before")
    order = Window.partitionBy("source", "bin").orderBy("rank", "u", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(order)
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("p") > 0) & (upto - F.col("size") / 2 <= wanted)
    taken = F.col("whole") * F.col("size") + F.when(extra, F.col("size")).otherwise(F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "copies", "row")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, also where rows share a doc_id or have none."""
    rows = numbered(docs)
    taken = _taken(rows, F.col("_row"), doc_id, text, source, **how).where("taken > 0")
    times = taken.select(F.col("row").alias("_row"), F.floor(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    out = rows.join(times, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*docs.columns)
