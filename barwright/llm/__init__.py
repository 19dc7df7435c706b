"""Operators for preparing training text, with their queries."""

import importlib

_QUERIES = {
    "tokens": "op1_token_files",
    "html_diff": "op2_html_text",
    "pieces": "op3_sentencepiece",
    "phrases": "op5_fingerprints",
    "licenses": "op9_license_scan",
    "topk": "op10_exact_top_k",
    "langid": "op8_language_id",
    "simhash": "op6_simhash_near_dedup",
    "secret_scan": "op7_secret_scan",
    "mixing": "op4_mix_sources",
    "packing": "op11_best_fit_packing",
    "repeats": "op12_periodic_runs",
    "turns": "op13_conversation_repair",
}

QUERIES = {}
SQL = {}
for _module, _name in _QUERIES.items():
    _found = importlib.import_module(f"barwright.llm.{_module}")
    QUERIES[_name] = getattr(_found, _name)
    if hasattr(_found, f"{_name.split('_')[0].upper()}_SQL"):
        SQL[_name] = getattr(_found, f"{_name.split('_')[0].upper()}_SQL")
