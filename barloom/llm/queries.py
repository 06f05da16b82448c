"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroids, divergence, edits, exact, forest, jaccard, mixing, oracles, packing, quality, records, secrets, suffix, warc

def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_divergence": quality.op1_query,
    "op2_poisson_mixing": mixing.op2_query,
    "op3_warc_salvage": warc.op3_query,
    "op4_suffix_dedup": suffix.op4_query,
    "op5_secret_trigrams": secrets.op5_query,
    "op6_token_records": records.op6_query,
    "op7_edit_counts": edits.op7_query,
    "op8_patricia_dedup": exact.op8_query,
    "op9_tier_packing": packing.op9_query,
    "op10_parity_sketch_join": jaccard.op10_query,
    "op11_source_divergence": divergence.op11_query,
    "op12_centroid_screening": centroids.op12_query,
    "op13_projection_forest": forest.op13_query,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_quality_divergence": oracles.quality_sql(),
    "op2_poisson_mixing": mixing.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op4_suffix_dedup": oracles.SUFFIX,
    "op5_secret_trigrams": oracles.secrets_sql(),
    "op8_patricia_dedup": exact.ORACLE,
    "op10_parity_sketch_join": oracles.JACCARD,
    "op11_source_divergence": divergence.ORACLE,
    "op12_centroid_screening": centroids.ORACLE,
}
