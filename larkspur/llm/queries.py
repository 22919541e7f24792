"""The operators' queries, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import mixing, ranked_search
from larkspur.llm.decontamination import op1_decontamination
from larkspur.llm.embedding_links import op4_embedding_links
from larkspur.llm.language import op9_language
from larkspur.llm.mixing import op12_mixing
from larkspur.llm.packing import op6_pack
from larkspur.llm.periodic import op13_periodic_runs
from larkspur.llm.pii import op2_pii
from larkspur.llm.quality import op8_quality
from larkspur.llm.ranked_search import op11_ranked_search
from larkspur.llm.simhash import op10_simhash
from larkspur.llm.substring_dedup import op5_substring_dedup
from larkspur.llm.token_count import op7_token_counts
from larkspur.llm.token_store import op3_token_store


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_token_store": op3_token_store,
    "op4_embedding_links": op4_embedding_links,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pack": op6_pack,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_mixing": op12_mixing,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}

#: Exact answers in DuckDB SQL over whole tables, where SQL is quick enough.
ORACLES: dict[str, str] = {
    "op11_ranked_search": ranked_search.SQL,
    "op12_mixing": mixing.SQL,
    "op4_embedding_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON r.other = p.a
)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links,
  (SELECT min(other) FROM reach r WHERE r.id = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(other) FROM reach r WHERE r.id = v.vec_id) AS kept
FROM v""",
}
