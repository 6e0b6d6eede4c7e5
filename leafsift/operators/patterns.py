"""Token and phrase patterns: the language, its checks, and a cheap test that spares blocks.

A pattern is a list of token predicates (LEMMA, LOWER, TEXT with REGEX, POS,
ENT_TYPE, LIKE_NUM, IS_PUNCT; values, IN or NOT_IN; OP ``? * + !``), the form
users of rule-based matchers already write. ``operators/automaton.py`` runs them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from leafsift.functions.lemmas import FORMS
from leafsift.functions.text import literal_regex
from leafsift.operators.tokens import ENT_LETTERS, NUMBER_WORDS, POS_LETTERS, split_tokens

Token = dict[str, Any]

ATTRIBUTES = {"LEMMA", "LOWER", "TEXT", "POS", "ENT_TYPE", "LIKE_NUM", "IS_PUNCT"}
KNOWN = {"POS": POS_LETTERS, "ENT_TYPE": ENT_LETTERS}


def checked(pattern: Sequence[Token]) -> list[Token]:
    """A pattern as it is, if every token is of the language."""
    for token in pattern:
        if set(token) - ATTRIBUTES - {"OP"}:
            raise ValueError(f"unsupported token attribute {sorted(set(token) - ATTRIBUTES - {'OP'})}")
        if token.get("OP") not in (None, "?", "*", "+", "!"):
            raise ValueError(f"unknown OP {token['OP']!r}")
        for name in ATTRIBUTES & set(token):
            spec = token[name]
            if isinstance(spec, dict) and (len(spec) != 1 or set(spec) - ({"IN", "NOT_IN", "REGEX"} if name == "TEXT" else {"IN", "NOT_IN"})):
                raise ValueError(f"unsupported predicate {spec!r}")
            if isinstance(spec, dict) and "REGEX" in spec:
                re.compile(spec["REGEX"])
            words = [spec] if not isinstance(spec, dict) else [w for v in spec.values() if not isinstance(v, str) for w in v]
            unknown = [w for w in words if name in KNOWN and w not in KNOWN[name]]
            if unknown:
                raise ValueError(f"the annotation has no {unknown}")
    return list(pattern)


def token_patterns(patterns: list[Any], kind: str = "text") -> list[list[Token]]:
    """All patterns of a metric as token predicates; ``kind`` is ``text`` or ``phrase`` (equal token by token in lower case)."""
    if not isinstance(patterns, list):
        raise ValueError("patterns must be a list")
    if kind == "text":
        return [checked(p) for p in patterns]
    if kind == "phrase":
        return [[{"LOWER": t.lower()} for t in split_tokens(p)] for p in patterns]
    raise ValueError(f"{kind!r} is not a pattern kind")


def _stems(token: dict[str, Any]) -> set[str] | None:
    """Beginnings of every word a required token can be, or None if it can be anything."""
    if token.get("OP") not in (None, "+"):
        return None
    for attribute in ("LOWER", "LEMMA"):
        spec = token.get(attribute)
        words = [spec] if isinstance(spec, str) else (spec or {}).get("IN") if spec else None
        if not words:
            continue
        stems = {w.strip() for w in words}
        if attribute == "LEMMA":
            # Forms keep the word but for a last y or e; other forms are listed.
            stems |= {w[:-1] for w in words if w.endswith(("y", "e"))}
            stems |= {form for form, lemma in FORMS.items() if lemma in words}
        return stems
    if token.get("LIKE_NUM") or token.get("ENT_TYPE") == "CARDINAL":
        return {"[0-9]"} | set(NUMBER_WORDS)
    return None


def quick_regex(patterns: list[Any], kind: str) -> str | None:
    """A cheap test on lower-cased text that every matching block passes; None if there is none.

    It spares the annotation of blocks that cannot match: each pattern gives
    one required token, the one whose words look rarest (few and long).
    """
    needed: set[str] = set()
    for pattern in patterns:
        if kind == "phrase":
            needed.add(literal_regex(max(split_tokens(pattern.lower()), key=len)))
            continue
        options = [s for s in map(_stems, pattern) if s]
        if not options:
            return None
        best = min(options, key=lambda s: sum(0.1 ** (1 if w == "[0-9]" else len(w)) for w in s))
        needed |= {s if s == "[0-9]" else literal_regex(s) for s in best}
    return "|".join(sorted(needed))
