"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, html, media, mixing, neardup, ordering, quality, repeats, search, sharding
from tidemark.llm.common import table


def queries() -> dict:
    return {
        "op1_quality": lambda spark, d: quality.classify(table(spark, d, "documents"), table(spark, d, "labels")),
        "op2_topk": lambda spark, d: search.embedding_neighbours(table(spark, d, "embeddings")),
        "op3_sharding": lambda spark, d: sharding.document_shards(table(spark, d, "documents")),
        "op4_bpe": lambda spark, d: bpe.digest_documents(table(spark, d, "documents")),
        "op5_html": lambda spark, d: html.extract_pages(table(spark, d, "pages")),
        "op6_repeats": lambda spark, d: repeats.document_repeats(table(spark, d, "documents")),
        "op7_mixing": lambda spark, d: mixing.document_mix(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_neardup": lambda spark, d: neardup.document_components(table(spark, d, "documents")),
        "op9_media": lambda spark, d: media.document_audio(table(spark, d, "documents")),
        "op10_training_order": lambda spark, d: ordering.document_order(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": search.TOP_K_SQL, "op3_sharding": sharding.SHARDS_SQL, "op5_html": html.ARTICLES_SQL, "op6_repeats": repeats.REPEATS_SQL, "op7_mixing": mixing.MIX_SQL, "op8_neardup": neardup.COMPONENTS_SQL}
