"""Queries of this subpackage, and the SQL of those that SQL can express."""

import corpus_pipeline
from ebbtide.llm import chat, decontaminate, embedding_dedup, language_id, packing, periodic_runs, quality, ranked_search, secret_scan, simhash, token_count, toxicity, url_filter

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_chat_formatting": chat.query,
    "op3_secret_scans": secret_scan.query,
    "op4_simhash_dedup": simhash.query,
    "op5_decontamination": decontaminate.query,
    "op6_packing": packing.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_url_filters": url_filter.query,
    "op9_toxicity": toxicity.query,
    "op10_token_counts": token_count.query,
    "op11_quality_classifier": quality.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_ranked_search": ranked_search.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_chat_formatting": chat.ORACLE,
    "op3_secret_scans": secret_scan.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
    "op8_url_filters": url_filter.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
