"""The registered queries of the training-data operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tendermill.llm import chat, exact, infill, jaccard, lines, mixing, neighbours, packing, scoring, secrets, tokens, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(_table(spark, sf_dir, "documents"))


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.formatted(turns.unionByName(added)))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lm_scores(_table(spark, sf_dir, "documents"), lambda doc_id: toxicity.fold(doc_id, 10) == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 4) == 2
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), lambda doc_id: toxicity.fold(doc_id, 4) != 2)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.secret_spans(_table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_vectors": op5_near_vectors,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_lm_scores": op9_lm_scores,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

def _secret_rules() -> str:
    """The rules of the scan as rows of SQL; either case is spelled out, since there it would take letters beyond ASCII."""
    def text(pattern: str) -> str:
        if pattern.startswith("(?i:"):
            words, _, rest = pattern[4:].partition(")")
            pattern = f"(?:{''.join(f'[{c}{c.upper()}]' if c.isalpha() else c for c in words)}){rest}"
        return "'" + pattern.replace("'", "''") + "'"

    base = {r.kind for r in secrets.BASE}
    return ", ".join(f"({i}, '{r.kind}', {text(r.head)}, {text(r.value)}, {r.least}, {r.kind in base})"
                     for i, r in enumerate(secrets.BASE + secrets.FURTHER))


ORACLE_SQL: dict[str, str] = {
    "op2_pareto_mix": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('17-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100
             - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
         row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS place
  FROM s),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, place) FROM l WHERE 2 * source_size >= weight * level)) AS target FROM l),
c AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT doc_id, size, source_size, target,
       CAST(floor(copies) * size + CASE WHEN copies > floor(copies) AND upto - size / 2 <= target - floor(copies) * source_size THEN size ELSE 0 END AS BIGINT) AS taken
FROM r""",
    "op3_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)""",
    "op12_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT * FROM (VALUES {_secret_rules()}) r (place, kind, head, value, least, base)),
m AS (
  SELECT row_no, place, kind, least, base, len(found) AS many, found, regexp_extract_all(t, head || '(' || value || ')', 1) AS inner_part,
         string_split_regex(t, head || value) AS apart
  FROM (SELECT *, regexp_extract_all(t, head || value) AS found FROM d, r) x WHERE len(found) > 0),
s AS (
  SELECT row_no, place, kind, base, least, length(found[i]) AS size, length(inner_part[i]) AS inner_size,
         CAST(list_sum(list_transform(apart[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS begins
  FROM (SELECT *, unnest(range(1, many + 1)) AS i FROM m) x),
k AS (SELECT row_no, place, base, begins, kind, kind || ':' || begins || ':' || (begins + size) AS span FROM s WHERE inner_size >= least)
SELECT doc_id, {', '.join(f"(SELECT count(*) FROM k WHERE k.row_no = d.row_no AND kind = '{x.kind}') AS n_{x.kind}" for x in secrets.BASE)},
       sha256(coalesce((SELECT string_agg(span, ',' ORDER BY begins, place) FROM k WHERE k.row_no = d.row_no AND base), '')) AS base_sha256,
       coalesce((SELECT string_agg(span, ',' ORDER BY begins, place) FROM k WHERE k.row_no = d.row_no), '') AS spans
FROM d""",
    "op13_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90
              THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
