"""Operators for training-data pipelines; each module holds one operator, its query and its SQL."""

from lakework.llm import jaccard, lexical, negatives, packing, pieces, pii, secrets, sharding, tiling, toxicity, urls, vectors, warc

QUERIES = {
    "op1_decontamination": tiling.op1_decontamination,
    "op2_embeddings": vectors.op2_embeddings,
    "op3_warc": warc.op3_warc,
    "op4_sharding": sharding.op4_sharding,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_url_filter": urls.op6_url_filter,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_secrets": secrets.op9_secrets,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLE = {
    "op2_embeddings": vectors.SQL,
    "op5_jaccard": jaccard.SQL,
    "op6_url_filter": urls.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_hard_negatives": negatives.SQL,
}

__all__ = ["ORACLE", "QUERIES"]
