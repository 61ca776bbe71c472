"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that defines it.
MODULES = {
    "op1_exact_topk": "topk",
    "op2_ngram_jaccard": "ngram_jaccard",
    "op3_line_dedup": "line_dedup",
    "op4_sharding": "sharding",
    "op5_fingerprints": "fingerprint",
    "op6_mixing": "mixing",
    "op7_quality_knn": "quality",
    "op8_html_extraction": "html_main",
    "op9_bestfit_packing": "packing",
    "op10_license_scan": "license_scan",
    "op11_lm_scoring": "neural_lm",
    "op12_merkle_manifest": "merkle",
    "op13_source_divergence": "divergence",
}


def queries() -> dict:
    return {name: getattr(import_module(f"evidence_jobs.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from evidence_jobs.llm.divergence import OP13_SQL
    from evidence_jobs.llm.merkle import OP12_SQL
    from evidence_jobs.llm.topk import OP1_SQL

    return {"op1_exact_topk": OP1_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
