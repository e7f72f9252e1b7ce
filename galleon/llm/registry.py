"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from galleon.llm import collocations, decontaminate, fim, leaks, licenses, packing, pii, quality, simhash, store, substrings, topk, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_pii": pii.op4_pii,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_store": store.op7_token_store,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_secret_scan": leaks.op12_secret_scan,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE: dict[str, str] = {
    "op8_exact_topk": topk.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_secret_scan": leaks.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
