"""All queries of this folder: ``QUERIES[name](spark, sf_dir)`` and ``ORACLES[name]``."""

import importlib

from framepair.llm.common import ORACLES, QUERIES

MODULES = ("urls", "decontaminate", "weak", "warc", "rules", "substrings", "minhash", "packing", "language", "chat", "trie", "pieces", "whitening")

for _name in MODULES:
    importlib.import_module(f"framepair.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
