"""The queries of this subpackage and their SQL forms."""

from __future__ import annotations

from . import alignment, embedding_dedup, fingerprints, hard_negatives, html_extract, jaccard_join, mixing, packing, ppm, quality_cascade, rans, toxicity, url_filter

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_ppm": ppm.query,
    "op3_mixing": mixing.query,
    "op4_rans": rans.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_url_filter": url_filter.query,
    "op7_html_extract": html_extract.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_alignment": alignment.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_quality_cascade": quality_cascade.query,
}

ORACLES = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_quality_cascade": quality_cascade.ORACLE_SQL,
}
