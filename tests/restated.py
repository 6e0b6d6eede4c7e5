"""Small restatements of the rules on Python rows, to compare with."""

import re
from itertools import groupby

from leafsift.operators.tokens import split_tokens

JUNK = ["<image:", ".indd", "\ufffd", "\uf0b7", "\u2013"]


def table_like(text):
    return len(re.findall(r"\S\n[\d\W]", text)) > 3 or len(re.findall(r"\s\n[\d\s]", text)) > 2


def stitched(rows):
    """[(page, [paragraphs], text)] of one report from sorted (page, paragraph, text)."""
    tables = [r for r in rows if table_like(r[2])]
    runs = groupby(enumerate(tables), key=lambda e: (e[1][0], e[1][1] - e[0]))
    out = []
    for _, run in runs:
        members = [r for _, r in run]
        parts = [members[0][2]] + [m[2] for m in members[1:] if m[2].strip()]
        out.append((members[0][0], [m[1] for m in members], "\n".join(parts)))
    return out


def reduced(raw):
    return " ".join(line for line in raw.split("\n") if re.match("[A-Za-z]", line)).strip()


def cleaned(rows, contents=True, keep_last=False):
    """Cleaned (page, paragraph, text) of one report."""
    runs = stitched(rows)
    new = {}
    for number, (page, paragraphs, raw) in enumerate(runs, 1):
        for p in paragraphs:
            new[page, p] = ""
        if keep_last or number < len(runs):
            new[page, paragraphs[0]] = f"<TABLE {number} CONTENTS({reduced(raw)}) ENDTABLE>"
    out = []
    for page, paragraph, text in rows:
        text = new.get((page, paragraph), text)
        if text == "" or any(j in text for j in JUNK) or (not contents and text.startswith("<TABLE")):
            continue
        out.append((page, paragraph, re.sub(r"[^ -~]", " ", re.sub(r"\s+", " ", text))))
    return out


def fits(token, spec):
    """Does an annotated token (a dict) satisfy a predicate?"""
    fields = {"LEMMA": "lemma", "LOWER": "lower", "TEXT": "text", "POS": "pos", "ENT_TYPE": "ent",
              "LIKE_NUM": "like_num", "IS_PUNCT": "is_punct"}
    for name, want in spec.items():
        if name == "OP":
            continue
        have = token[fields[name]]
        if isinstance(want, dict):
            if "IN" in want and have not in want["IN"]:
                return False
            if "NOT_IN" in want and have in want["NOT_IN"]:
                return False
            if "REGEX" in want and not re.search(want["REGEX"], have):
                return False
        elif have != want:
            return False
    return True


def ends(tokens, pattern, start):
    """All ends of matches of a pattern from ``start``: sets of positions, one predicate at a time."""
    here = {start}
    for spec in pattern:
        op = spec.get("OP")
        ok = [fits(t, spec) != (op == "!") for t in tokens]
        step = {i + 1 for i in here if i < len(tokens) and ok[i]}
        if op in ("+", "*"):
            grow = set(step)
            while grow:
                grow = {i + 1 for i in grow if i < len(tokens) and ok[i]} - step
                step |= grow
        here = step | here if op in ("?", "*") else step
    return here


def first_match(tokens, patterns):
    """(start, end, pattern number) by lowest start, shortest, pattern order."""
    for start in range(len(tokens)):
        found = [(end, n) for n, p in enumerate(patterns) for end in ends(tokens, p, start) if end > start]
        if found:
            return (start, *min(found))
    return None


def phrase_patterns(phrases):
    return [[{"LOWER": t.lower()} for t in split_tokens(p)] for p in phrases]
