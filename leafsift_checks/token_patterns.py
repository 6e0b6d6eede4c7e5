"""Token patterns as regexes for RE2, for the comparison: every loop spelled out as it is written in the pattern.

RE2 runs without recursion, so nothing is simplified here; the operators' own
compiler is not used.
"""

from __future__ import annotations

from typing import Any

from leafsift.operators.tokens import ENT_LETTERS, POS_LETTERS, split_tokens

TOKEN = r"\x01[^\x01]*"
LIKE_NUM_LETTER, IS_PUNCT_LETTER = "N", "U"


def escaped(word: str) -> str:
    return "".join(c if c.isalnum() or c in " %_" else "\\" + c for c in word)


def one_of(spec: Any) -> str:
    words = [spec] if isinstance(spec, str) else spec["IN"]
    return "(?:" + "|".join(map(escaped, words)) + ")"


def letter(spec: Any, letters: dict[str, str]) -> str:
    names = [spec] if isinstance(spec, str) else spec["IN"]
    return "[" + "".join(letters[n] for n in names) + "]"


def token_regex(token: dict[str, Any]) -> str:
    """One token: lower, lemma, flags, text, as the SQL rows encode them."""
    if not set(token) - {"OP"}:
        return TOKEN
    field = {a: one_of(token[a]) if a in token else rf"[^{end}]*" for a, end in (("LOWER", r"\x02"), ("LEMMA", r"\x03"))}
    flags = (letter(token["POS"], POS_LETTERS) if "POS" in token else ".") + (letter(token["ENT_TYPE"], ENT_LETTERS) if "ENT_TYPE" in token else ".")
    flags += LIKE_NUM_LETTER if token.get("LIKE_NUM") else LIKE_NUM_LETTER + "?"
    flags += IS_PUNCT_LETTER if token.get("IS_PUNCT") else IS_PUNCT_LETTER + "?"
    text = rf"[^\x01]*?(?:{token['TEXT']['REGEX']})[^\x01]*" if "TEXT" in token else r"[^\x01]*"
    return rf"\x01{field['LOWER']}\x02{field['LEMMA']}\x03{flags}\x04{text}"


def compile_patterns(patterns: list[Any], kind: str) -> list[str]:
    if kind == "phrase":
        return ["".join(rf"\x01{escaped(t.lower())}\x02[^\x01]*" for t in split_tokens(p)) for p in patterns]
    loops = {"?": "??", "*": "*?", "+": "+?"}
    return ["".join(f"(?:{token_regex(t)}){loops[t['OP']]}" if "OP" in t else token_regex(t) for t in p) for p in patterns]
