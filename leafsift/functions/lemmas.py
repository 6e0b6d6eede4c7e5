"""Lemmas of English words by suffix rules: the longest suffix with a rule decides, listed forms come first."""

from __future__ import annotations

import re

# Word forms that the rules would get wrong, by lemma.
IRREGULAR = {
    "be": "am is are was were been being 's 'm 're",
    "have": "has had having 've",
    "do": "does did done doing",
    "die": "died dies dying",
    "lie": "lies lied lying",
    "go": "goes going gone went",
    "see": "seeing seen saw",
    "agree": "agreed agreeing",
    "create": "created creating",
    "add": "added adding",
    "regret": "regrets regretted regretting",
    "total": "totals totalled totalling totaled totaling",
    "invite": "invited inviting",
    "man": "men",
    "woman": "women",
    "child": "children",
    "people": "peoples",
    "bus": "buses",
    "this": "this",
    "gas": "gas",
    "always": "always",
    "species": "species",
    "series": "series",
    "business": "businesses",
    "process": "processes",
    "during": "during",
    "morning": "mornings",
    "evening": "evenings",
    "ceiling": "ceilings",
    "sibling": "siblings",
}
# Words that only look like forms of others.
UNCHANGED = "during morning evening ceiling sibling nothing something anything everything hundred sacred naked wicked".split()
FORMS = {form: lemma for lemma, forms in IRREGULAR.items() for form in forms.split()} | {w: w for w in UNCHANGED}

_PLAIN = re.compile(r"[a-z]+").fullmatch
_VOWEL = re.compile(r"[aeiouy]").search
_DOUBLED = re.compile(r"(?:bb|dd|gg|mm|nn|pp|rr|tt)\Z").search
# Stems whose verb ends in e: by their last letters, and short ones of one vowel and one consonant.
_DROPPED_E = re.compile(
    r"(?:[^eo]at|iz|is|[aeo]s|[^c]us|ns|rs|[aeiou]c|nc|rc|v|u|dg|rg|ag|[ae]ng|[bcdfgkptz]l|[^aeiou][iu]r|quir|plor|stor|[pl]ar|"
    r"[vcsu]id|lud|rud|[bmfg]in|[bcp]ut|let|mot|vot|quot|vok)\Z").search
_SHORT = re.compile(r"[^aeiou]*[aeiou][^aeiouwxy]").fullmatch


def _verb(stem: str) -> str | None:
    """The verb of a form without its -ing or -ed."""
    if not _VOWEL(stem):
        return None
    if _DOUBLED(stem):
        return stem[:-1]
    if _DROPPED_E(stem) or _SHORT(stem):
        return stem + "e"
    return stem if len(stem) > 2 else None


def _y(stem: str) -> str | None:
    return stem + "y" if len(stem) > 1 else None


def _same(stem: str) -> str | None:
    return stem or None


# By suffix, what becomes of the rest; None leaves the word as it is.
RULES = {
    "ies": _y, "ied": _y, "iest": _y, "ing": _verb, "ed": lambda stem: None if stem.endswith("e") else _verb(stem),
    "est": lambda stem: stem[:-1] if _DOUBLED(stem) and len(stem) > 2 else None,
    **{end + "es": lambda stem, end=end: stem + end if stem else None for end in ("ss", "sh", "ch", "x", "z")},
    "s": lambda stem: _same(stem) if len(stem) > 1 and stem[-1] not in "siu" else None,
}
_LONGEST = max(map(len, RULES))


def lemma(word: str) -> str:
    """Lemma of a lower-cased word; words with other characters than a-z stay."""
    if word in FORMS:
        return FORMS[word]
    if word[-1:] not in "sdgt" or not _PLAIN(word):
        return word
    for size in range(min(_LONGEST, len(word)), 0, -1):
        rule = RULES.get(word[-size:])
        if rule is not None:
            return rule(word[:-size]) or word
    return word
