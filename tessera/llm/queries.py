"""Registered queries of the subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import latent, line_crf, line_rules, mixing, partenum, pii, secrets, sharding, suffix_merge, token_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(_table(spark, sf_dir, "documents"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(_table(spark, sf_dir, "documents"))


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents"))


def op6_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"), shards=24)


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.line_crf_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_secret_battery,
    op2_line_first,
    op3_separator_scan,
    op4_partenum_join,
    op5_boosted_pii,
    op6_suffix_runs,
    op7_hilbert_shards,
    op8_latent_leaks,
    op9_source_mix,
    op10_line_crf,
    pipeline,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: Words, distinct shingles and links by their numbers in common; classes by reach over links, as sets of pairs.
OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:], true), lambda z: concat_ws(' ', z[1], z[2], z[3]))) END AS s
    FROM words
), texts AS (
    SELECT md5(array_to_string(list_sort(s), chr(10))) AS t, any_value(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1
), places AS (
    SELECT rep, len(s) AS n, unnest(s) AS x FROM texts
), common AS (
    SELECT a.rep AS a, b.rep AS b, a.n + b.n - count(*) AS either, count(*) AS n_both
    FROM places a JOIN places b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n
), links AS (
    SELECT a, b FROM common WHERE 100 * n_both >= 90 * either
    UNION ALL SELECT b, a FROM common WHERE 100 * n_both >= 90 * either
), reach AS (
    SELECT rep AS a, rep AS b FROM texts
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN texts ON len(sets.s) > 0 AND md5(array_to_string(list_sort(sets.s), chr(10))) = texts.t
LEFT JOIN least_of ON texts.rep = least_of.a
"""

#: Every string of 200 bytes; those that stand again cover bytes, and covers that touch or overlap are one run.
OP6_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS t FROM documents
), strings AS (
    SELECT row, unnest(range(1, octet_length(t) - 198)) AS pos, t FROM texts WHERE octet_length(t) >= 200
), named AS (
    SELECT row, pos, md5(array_slice(t, pos, pos + 199)) AS name FROM strings
), again AS (
    SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY name) AS times FROM named) WHERE times > 1
), begins AS (
    SELECT row, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY row ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM again
), numbered AS (
    SELECT row, pos, sum(new) OVER (PARTITION BY row ORDER BY pos) AS run FROM begins
), runs AS (
    SELECT row, run, min(pos) AS a, max(pos) + 199 AS b FROM numbered GROUP BY row, run
), spans AS (
    SELECT row, count(*) AS n_spans, sum(b - a + 1) AS n_removed, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM runs GROUP BY row
), left_over AS (
    SELECT row, doc_id, t, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        list_concat(coalesce(froms, []), [octet_length(t) + 1]) AS ends, list_concat([0], coalesce(tos, [])) AS begins
    FROM texts LEFT JOIN spans USING (row)
)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
    sha256(from_hex(array_to_string(list_transform(range(1, len(ends) + 1), lambda i: hex(array_slice(t, begins[i] + 1, ends[i] - 1))), ''))) AS kept_sha256
FROM left_over
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries whose rows follow from the texts alone; they compare all pairs and hold all strings."""
    return {"op4_partenum_join": OP4_SQL, "op6_suffix_runs": OP6_SQL}
