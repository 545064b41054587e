"""The queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivum.llm import (
    decontaminate, fingerprints, jaccard_join, language_model, mixture_packing, packing, periodic_runs, quality, substring_dedup, threshold_search, token_counts, toxicity, url_filter,
)
from archivum.llm.common import table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"[x FOR x IN regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+') IF x <> '']"
_SETS = "list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)"

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT doc_id, {_SETS} AS sh FROM w),
s AS (SELECT doc_id, unnest(sh) AS sh FROM d),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN d a ON a.doc_id = x JOIN d b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.sh) + len(b.sh) - n)),
r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id FROM d JOIN (SELECT id, min(m) AS m FROM r GROUP BY id) ON id = doc_id
"""

DECONTAMINATION_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents), bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bs AS (SELECT item_id, least(len(ws), 5) AS width, unnest({_SETS}) AS sh FROM bw),
runs AS (SELECT doc_id, width, unnest([array_to_string(ws[i:i + width - 1], ' ') FOR i IN range(1, len(ws) - width + 2)]) AS sh
FROM dw CROSS JOIN (SELECT DISTINCT width FROM bs) WHERE len(ws) >= width),
ds AS (SELECT DISTINCT doc_id, width, sh FROM runs),
size AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
both_ AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (width, sh) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, k AS n_shared, k / CAST(n AS DOUBLE) AS containment FROM both_ JOIN size USING (item_id) WHERE k >= 0.8 * n
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": lambda s, d: jaccard_join.jaccard_components(_documents(s, d)),
        "op2_best_fit_packing": lambda s, d: packing.best_fit_packing(_documents(s, d)),
        "op3_toxicity": lambda s, d: toxicity.toxicity_scores(_documents(s, d), table(s, d, "labels")),
        "op4_document_fingerprints": lambda s, d: fingerprints.fingerprints(_documents(s, d)),
        "op5_quality_classifier": lambda s, d: quality.quality_scores(_documents(s, d), table(s, d, "labels")),
        "op6_benchmark_decontamination": lambda s, d: decontaminate.contaminated(_documents(s, d), table(s, d, "benchmark")),
        "op7_suffix_array_dedup": lambda s, d: substring_dedup.removed_bytes(_documents(s, d)),
        "op8_lm_scoring": lambda s, d: language_model.language_model_scores(_documents(s, d)),
        "op9_url_filters": lambda s, d: url_filter.url_verdicts(table(s, d, "pages")),
        "op10_token_counts": lambda s, d: token_counts.token_counts(_documents(s, d)),
        "op11_mixture_packing": lambda s, d: mixture_packing.mixture_packing(_documents(s, d), content=mixture_packing.CRC),
        "op12_periodic_runs": lambda s, d: periodic_runs.run_digests(periodic_runs.periodic_runs(_documents(s, d), rewrite=periodic_runs.planted)),
        "op13_ranked_search": lambda s, d: threshold_search.threshold_search(_documents(s, d), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": JACCARD_SQL, "op6_benchmark_decontamination": DECONTAMINATION_SQL, "op9_url_filters": url_filter.ORACLE_SQL, "op13_ranked_search": threshold_search.ORACLE_SQL}
