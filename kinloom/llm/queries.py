"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from kinloom.llm import chat, decontaminate, jaccard, language, packing, quality, repetition, secrets, token_counts, toxicity

MODULES = (decontaminate, secrets, language, chat, token_counts, quality, toxicity, packing, repetition, jaccard)

QUERIES = {name: run for module in MODULES for name, run in vars(module).items() if name.startswith("op") and name[2].isdigit()}

SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
