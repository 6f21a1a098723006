"""Queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from . import ann, jaccard_join, language_id, mixing, packing, pii, repeats, toxicity, transport_stream, url_filter


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_kmeans_tree": ann.op1_kmeans_tree,
        "op2_transport_stream": transport_stream.op2_transport_stream,
        "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
        "op4_language_id": language_id.op4_language_id,
        "op5_mixing": mixing.op5_mixing,
        "op6_pii": pii.op6_pii,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_packing": packing.op8_packing,
        "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
        "pipeline": _pipeline,
    }


def oracle_sql():
    return {"op10_url_filter": url_filter.SQL}
