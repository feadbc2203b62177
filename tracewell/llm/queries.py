"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_html_text": "html_text",
    "op2_simhash": "simhash",
    "op3_language_id": "language_id",
    "op4_decontaminate": "decontaminate",
    "op5_mix_sources": "mixing",
    "op6_url_filter": "url_filter",
    "op7_suffix_dedup": "suffix_dedup",
    "op8_neighbours": "neighbours",
    "op9_quality": "quality",
    "op10_toxicity": "toxicity",
    "op11_super_kmers": "superkmers",
    "op12_fill_middle": "fill_middle",
    "op13_source_divergence": "source_divergence",
}


def queries() -> dict:
    return {name: import_module(f"tracewell.llm.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tracewell.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {k: v for k, v in found.items() if v}
