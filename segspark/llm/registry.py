"""All queries of this package: name -> (function, check SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["shards", "mixing", "licences", "quality", "token_files", "bpe", "language", "digest", "minmax", "suffix_runs", "variants", "conversations",
           "html_text"]


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for module in MODULES:
        for name, (function, oracle) in import_module(f"segspark.llm.{module}").QUERIES.items():
            queries[name] = function
            if oracle:
                sql[name] = oracle
    return queries, sql
