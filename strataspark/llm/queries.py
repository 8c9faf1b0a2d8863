"""Queries of problems 3 to 8 and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_parsing", "q_credentials", "q_provenance", "q_tokens", "q_packing", "q_sentences")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
