"""All queries of the numbered operators."""

import importlib

from assaylake.llm.registry import ORACLES, QUERIES

MODULES = ["mixing", "neardup", "packing", "passages", "phrases", "prefix_hashes", "prefix_trie", "quality", "rules", "search", "token_files", "toxicity", "warc"]

for _module in MODULES:
    importlib.import_module(f"assaylake.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
