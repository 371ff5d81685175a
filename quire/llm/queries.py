"""The queries op1 to op10 and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name, module and function; the SQL is the module's OPn_SQL, if it has one.
OPERATORS = [
    ("op10_lm", "lm"),
    ("op3_chat", "chat"),
    ("op1_search", "search"),
    ("op5_extraction", "extraction"),
    ("op4_language", "language"),
    ("op9_toxicity", "toxicity"),
    ("op2_decontaminate", "decontaminate"),
    ("op8_suffixes", "suffixes"),
    ("op6_simhash", "simhash"),
    ("op7_mixing", "mixing"),
]


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"quire.llm.{module}"), name) for name, module in OPERATORS}
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in OPERATORS:
        sql = getattr(importlib.import_module(f"quire.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            found[name] = sql
    pipeline = importlib.import_module("corpus_pipeline").ORACLE_SQL
    return found | ({"pipeline": pipeline} if pipeline else {})
