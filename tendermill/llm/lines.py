"""Repeated runs of lines, by a suffix array over line ids. DataFrame functions only.

Lines without a word are passed over: they neither count nor interrupt a run. A line goes when it lies in a run of
consecutive lines of one document with at least ``min_words`` words together that occurs earlier, in the order of doc_id, then
line. The first copy of a run stays, and so does anything shorter.

1. Lines get ids (digests); positions whose line occurs once cannot lie in a repeated run and drop out.
2. Prefix doubling ranks the suffixes by 1, 2, 4, ... lines: the rank of twice the length is the order of the pair of
   ranks at both halves. Ranks come from a range sort of the distinct pairs, so the order is that of the suffix array, to the
   depth that step 3 needs; suffixes whose prefix is unique drop out.
3. Suffixes that share their first n lines are an interval of the array with a longest common prefix of n or more; two
   overlapping ranks identify it. Taken for the shortest runs from each line on, and up to each line, that reach
   ``min_words``, these intervals cover every maximal repeated run. All members of an interval but its first go.

The work grows with the number of lines times the logarithm of a run's lines. Distinct pairs, not positions, are sorted, so a
line in a third of all documents is one row there.

Defined results: null text stays null and has no lines; a text of blank lines stays as it is; rows with the same doc_id and the
same text count as one document and get the same result; a null doc_id comes last in the order; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.store import checkpointed, stored

#: Words that make a run long enough to go: passages, not headings or stock sentences.
MIN_WORDS = 25
#: Bytes of removed line numbers, and of a document's row without them, that may be broadcast; beyond that both sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
_WORD = "[^\\x20\\x09-\\x0D]+"


def _key() -> Column:
    return F.xxhash64("_text")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, key, ord, line_no, line, words): lines with words; ``ord`` numbers them within the document."""
    numbered = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    worded = F.filter(numbered, lambda s: s["line"].rlike(_WORD))
    rows = docs.where(F.col("_text").isNotNull()).select("_doc", "_text").withColumn("_key", _key())
    rows = rows.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.posexplode(worded).alias("ord", "s"))
    return rows.select("doc", "key", "ord", F.col("s.no").alias("line_no"), F.unhex(F.md5("s.line")).alias("line"), F.regexp_count("s.line", F.lit(_WORD)).alias("words"))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with a rank that grows in their order: parts by range, sorted within."""
    return checkpointed(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def positions(lines: DataFrame) -> DataFrame:
    """Positions of repeated lines: ``pos`` follows the documents' order, and is consecutive along lines that stand together."""
    lines = stored(lines)
    ids = _ranked(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "line")
    # documents that are the same row again count once
    kept = lines.join(ids, "line").groupBy("doc", "key", "ord").agg(*(F.min(c).alias(c) for c in ("line_no", "words", "rank")))
    order = [F.col("doc").asc_nulls_last(), F.col("key"), F.col("ord")]
    kept = checkpointed(kept.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    island = (F.col("pos") - F.col("ord")).alias("island")
    return kept.select("*", island)


def shortest_runs(table: DataFrame, min_words: int) -> DataFrame:
    """(start, lines) of the shortest runs with ``min_words`` words from each line on, and up to each line."""
    one = Window.partitionBy("doc", "key", "island")
    upto = one.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("end", F.sum("words").over(upto)).withColumn("begin", F.col("end") - F.col("words"))
    ahead = one.orderBy("begin").rangeBetween(0, min_words - 1)
    back = one.orderBy("end").rangeBetween(-(min_words - 1), 0)
    table = table.select("pos", "begin", "end", F.count("*").over(ahead).alias("n_ahead"), F.max("end").over(ahead).alias("reach"),
                         F.count("*").over(back).alias("n_back"), F.min("begin").over(back).alias("from"))
    ahead = table.where(F.col("reach") - F.col("begin") >= min_words).select(F.col("pos").alias("start"), F.col("n_ahead").alias("lines"))
    back = table.where(F.col("end") - F.col("from") >= min_words).select((F.col("pos") - F.col("n_back") + 1).alias("start"), F.col("n_back").alias("lines"))
    return ahead.unionByName(back).distinct()


def suffix_ranks(table: DataFrame, levels: int) -> DataFrame:
    """(pos, level, rank): the rank of every repeated prefix of 2 ** level lines among all of that length."""
    now = table.select("pos", "doc", "key", "island", "rank")
    every = now.select("pos", F.lit(0).alias("level"), "rank")
    for level in range(levels):
        later = now.select((F.col("pos") - (1 << level)).alias("pos"), "doc", "key", "island", F.col("rank").alias("then"))
        same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.island") == F.col("b.island"))
        pairs = now.alias("a").join(later.alias("b"), (F.col("a.pos") == F.col("b.pos")) & same).select("a.*", "b.then").withColumnRenamed("rank", "half")
        keys = pairs.groupBy("half", "then").agg(F.count("*").alias("n")).where("n > 1").select("half", "then")
        now = checkpointed(pairs.join(_ranked(keys, "half", "then"), ["half", "then"]).select("pos", "doc", "key", "island", "rank"))
        every = every.unionByName(now.select("pos", F.lit(level + 1).alias("level"), "rank"))
    return every


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, key, line_no) of the lines to remove."""
    table = positions(line_table(docs))
    runs = checkpointed(shortest_runs(table, min_words).withColumn("level", F.floor(F.log2("lines")).cast("int")))
    levels = runs.agg(F.max("level")).first()[0] or 0
    ranks = suffix_ranks(table, levels)
    head = ranks.select(F.col("pos").alias("start"), "level", F.col("rank").alias("head"))
    tail = ranks.select(F.col("pos").alias("last"), "level", F.col("rank").alias("tail"))
    runs = runs.withColumn("last", F.col("start") + F.col("lines") - F.expr("shiftleft(1, level)"))
    runs = checkpointed(runs.join(head, ["start", "level"]).join(tail, ["last", "level"]).select("start", "lines", "head", "tail"))
    interval = runs.groupBy("lines", "head", "tail").agg(F.min("start").alias("first"))
    later = runs.join(interval, ["lines", "head", "tail"]).where("start > first")
    gone = later.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)).alias("pos")).distinct()
    return table.join(gone, "pos").select("doc", "key", "line_no")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs, and two columns: ``n_lines`` of the source and ``n_removed``."""
    rows = docs.withColumn("_doc", F.col(doc_id)).withColumn("_text", F.col(text).cast("string"))
    gone = later_copies(rows, min_words).groupBy("doc", "key").agg(F.collect_list("line_no").alias("_gone"))
    gone = checkpointed(gone.withColumnsRenamed({"doc": "_gone_doc", "key": "_gone_key"}))
    if (gone.agg(F.sum(F.size("_gone").cast("long") * 8 + ROW_BYTES)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    mine = F.col("_doc").eqNullSafe(F.col("_gone_doc")) & (_key() == F.col("_gone_key"))
    rows = rows.join(gone, mine, "left")
    parts = F.split("_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    rest = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")
    rows = rows.withColumn(text, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest))
    rows = rows.withColumn("n_lines", F.when(F.col("_text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
    rows = rows.withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return rows.select(*docs.columns, "n_lines", "n_removed")
