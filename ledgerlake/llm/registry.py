"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import chat, counts, decontam, lines, lm, mixing, neardup, quality, suffixdedup, tokens

MODULES = (suffixdedup, tokens, lines, chat, neardup, quality, lm, decontam, mixing, counts)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
