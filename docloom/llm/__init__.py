"""Operators for making training data, and the queries that apply them.

Nothing outside this folder imports it. ``queries()`` and ``oracles()`` are what the
entry point adds to its own when the folder is there.
"""

from __future__ import annotations

import importlib

_MODULES = ("embed_dup", "minhash", "lines", "language", "quality", "leaks", "tokens", "mixing", "shards", "warc",
            "secrets", "alignment", "variants")


def queries() -> dict:
    import corpus_pipeline

    out = {}
    for m in _MODULES:
        out |= importlib.import_module(f"docloom.llm.{m}").QUERIES
    return out | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    out = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"docloom.llm.{m}"), "ORACLES", {})
    return out
