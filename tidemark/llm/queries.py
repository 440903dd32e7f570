"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, mixing, near_dup, pii, preference, quality, repetition, runs, simhash, site_lines, structure, token_file, unigram

MODULES = (mixing, near_dup, token_file, quality, decontaminate, pii, repetition, site_lines, unigram, preference, simhash, runs, structure)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
