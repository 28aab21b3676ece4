"""The registered queries of this package and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from basketlens.llm import audit, centroids, jaccard, language, neighbours, packing, pages, pieces, quality, secrets, substrings, toxicity, urls


def queries():
    return {
        "op1_toxicity": toxicity.query,
        "op2_sentencepiece": pieces.query,
        "op3_substring_dedup": substrings.query,
        "op4_ngram_jaccard": jaccard.query,
        "op5_url_filters": urls.query,
        "op6_secret_scan": secrets.query,
        "op7_nearest_neighbours": neighbours.query,
        "op8_quality_rules": quality.query,
        "op9_language_id": language.query,
        "op10_best_fit_packing": packing.query,
        "op11_html_extraction": pages.query,
        "op12_centroid_clustering": centroids.query,
        "op13_filter_audit": audit.query,
    }


def oracle_sql():
    return {"op3_substring_dedup": substrings.ORACLE, "op4_ngram_jaccard": jaccard.ORACLE, "op12_centroid_clustering": centroids.ORACLE, "op13_filter_audit": audit.ORACLE}
