"""All token patterns of all metrics as one automaton over symbol classes.

Every place in a pattern is a bit; a step is a few operations on whole sets of
places. A token's class is the set of places whose predicate it satisfies,
remembered per word, and a set of places is a state whose successors are
remembered per class: the product of all patterns, determinised as far as the
text at hand asks for. Patterns are read backwards once, which tells where a
match of any pattern can begin; from the lowest such place of a metric its
patterns are read forwards to the nearest end. Time is in proportion to the
text, however long a block is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.operators.patterns import Token, token_patterns
from leafsift.operators.tokens import TOKEN, WordFacts

# Words, classes and states that a task remembers before it starts anew.
MOST = 1 << 17
FOUND = "array<struct<set:int,start:int,n:int,pattern:int,match_string:string>>"


def _predicate(token: Token):
    """Does ``(text, lower, lemma, pos, ent, like_num, is_punct)`` satisfy the token of a pattern?"""
    places = {"TEXT": 0, "LOWER": 1, "LEMMA": 2, "POS": 3, "ENT_TYPE": 4, "LIKE_NUM": 5, "IS_PUNCT": 6}
    tests = []
    for name, spec in token.items():
        if name == "OP":
            continue
        at = places[name]
        if not isinstance(spec, dict):
            tests.append(lambda t, at=at, spec=spec: t[at] == spec)
            continue
        if "REGEX" in spec:
            tests.append(lambda t, at=at, find=re.compile(spec["REGEX"]).search: find(t[at]) is not None)
        if "IN" in spec:
            tests.append(lambda t, at=at, words=frozenset(spec["IN"]): t[at] in words)
        if "NOT_IN" in spec:
            tests.append(lambda t, at=at, words=frozenset(spec["NOT_IN"]): t[at] not in words)
    wanted = token.get("OP") != "!"
    return lambda t: all(test(t) for test in tests) == wanted


class _Places:
    """Places of token lists, one after the other, each list followed by its end."""

    def __init__(self, lists: Sequence[list[Token]], number: dict[str, int]):
        self.first, self.ends, self.skip, self.loop = [], [], 0, 0
        self.of_test: dict[int, int] = {}
        at = 0
        for tokens in lists:
            self.first.append(at)
            for token in tokens:
                ops = {"+": (None, "*")}.get(token.get("OP"), (token.get("OP"),))
                for op in ops:
                    test = number[_named(token)]
                    self.of_test[test] = self.of_test.get(test, 0) | 1 << at
                    self.skip |= (op in ("?", "*")) << at
                    self.loop |= (op == "*") << at
                    at += 1
            self.ends.append(at)
            at += 1

    def closed(self, places: int) -> int:
        """With the places that are reached without a token."""
        while (more := places | (places & self.skip) << 1) != places:
            places = more
        return places

    def step(self, places: int, fit: int) -> int:
        fit &= places
        return self.closed(fit << 1 | fit & self.loop)


def _named(token: Token) -> str:
    return repr((sorted((k, repr(v)) for k, v in token.items() if k != "OP"), token.get("OP") == "!"))


class Automaton:
    """The sets of patterns, numbered; ``first_matches`` finds the first match of each."""

    def __init__(self, sets: Sequence[Sequence[list[Token]]]):
        lists = [(s, n, trimmed) for s, patterns in enumerate(sets) for n, p in enumerate(patterns) if (trimmed := _trimmed(p))]
        tokens = {_named(t): t for _, _, p in lists for t in p}
        number = {name: i for i, name in enumerate(tokens)}
        self.tests = [_predicate(t) for t in tokens.values()]
        self.forward = _Places([p for _, _, p in lists], number)
        self.backward = _Places([p[::-1] for _, _, p in lists], number)
        self.begin_back = self.backward.closed(sum(1 << f for f in self.backward.first))
        self.end_back = [(1 << e, s) for e, (s, _, _) in zip(self.backward.ends, lists)]
        self.begin = {s: self.forward.closed(sum(1 << f for f, (z, _, _) in zip(self.forward.first, lists) if z == s)) for s in range(len(sets))}
        self.end = {s: [(1 << e, n) for e, (z, n, _) in zip(self.forward.ends, lists) if z == s] for s in range(len(sets))}
        self.final = {s: sum(bit for bit, _ in ends) for s, ends in self.end.items()}
        self.clear()

    def clear(self) -> None:
        """Forget what was learnt from the text; the start state is number 0."""
        self.classes: dict[tuple, int] = {}
        self.of_token: dict[tuple, int] = {}
        self.fits: list[tuple[int, int]] = []  # by class: forward and backward places
        self.states: dict[int, int] = {self.begin_back: 0}
        self.places: list[int] = [self.begin_back]
        self.next: list[dict[int, int]] = [{}]
        self.begins: list[tuple[int, ...]] = [()]  # by state: sets with a match that begins here

    def class_of(self, token: tuple) -> int:
        """Number of the class of ``(text, lower, lemma, pos, ent, like_num, is_punct)``."""
        known = self.of_token.get(token)
        if known is None:
            passed = tuple(i for i, test in enumerate(self.tests) if test(token))
            known = self.classes.get(passed)
            if known is None:
                known = self.classes[passed] = len(self.fits)
                self.fits.append(tuple(sum(p.of_test.get(i, 0) for i in passed) for p in (self.forward, self.backward)))
            self.of_token[token] = known
        return known

    def _learn(self, state: int, kind: int) -> int:
        places = self.backward.step(self.places[state], self.fits[kind][1])
        ended = tuple(sorted({s for bit, s in self.end_back if places & bit}))
        places |= self.begin_back
        number = self.states.get(places)
        if number is None:
            number = self.states[places] = len(self.places)
            self.places.append(places)
            self.next.append({})
            self.begins.append(ended)
        self.next[state][kind] = number
        return number

    def first_matches(self, kinds: Sequence[int]) -> list[tuple[int, int, int, int]]:
        """``set, start, n, pattern`` of each set's first match: lowest start, then shortest, then pattern order."""
        state, start, follow, begins = 0, {}, self.next, self.begins
        for i in range(len(kinds) - 1, -1, -1):
            kind = kinds[i]
            after = follow[state].get(kind)
            state = self._learn(state, kind) if after is None else after
            if begins[state]:
                for s in begins[state]:
                    start[s] = i
        out = []
        for s, first in sorted(start.items()):
            places = self.begin[s]
            for i in range(first, len(kinds)):
                places = self.forward.step(places, self.fits[kinds[i]][0])
                if places & self.final[s]:
                    out.append((s, first, i - first + 1, next(n for bit, n in self.end[s] if places & bit)))
                    break
        return out


def _trimmed(pattern: list[Token]) -> list[Token]:
    """Without optional tokens at the end, which no shortest match has."""
    tokens = list(pattern)
    while tokens and tokens[-1].get("OP") in ("?", "*"):
        tokens.pop()
    return tokens


def _reader(automaton: Automaton):
    """From a text to its raw tokens and their classes. A word's facts are looked up once, its entity depends on its neighbours."""
    facts, split, known = WordFacts(), re.compile(TOKEN, re.ASCII).findall, {}

    def read(text: str) -> tuple[list[str], list[int]]:
        if len(known) > MOST or len(automaton.places) > MOST or len(automaton.of_token) > MOST:
            known.clear()
            automaton.clear()
        raw = split(text)
        kinds = []
        for i, t in enumerate(raw):
            word = known.get(t)
            if word is None:
                fixed = facts(t)
                # Numbers and percent signs wait for their neighbours.
                word = known[t] = (fixed, None if fixed[-1] is None else automaton.class_of(fixed[:4] + (fixed[-1],) + fixed[4:6]))
            fixed, kind = word
            if kind is None:
                ent = facts.entity(fixed, facts(raw[i - 1]) if i else None, facts(raw[i + 1]) if i + 1 < len(raw) else None)
                kind = automaton.class_of(fixed[:4] + (ent,) + fixed[4:6])
            kinds.append(kind)
        return raw, kinds

    return read


def _rows(batch: pa.RecordBatch, found: list[list[dict[str, Any]] | None]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("set", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("pattern", pa.int32()), ("match_string", pa.string())]))
    return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=[*batch.schema.names[1:], "_found"])


def with_matches(df: DataFrame, sets: Sequence[tuple[Sequence[Any], str]], of: str) -> DataFrame:
    """Add ``_found``: the first match of every set of patterns ``(patterns, kind)`` that has one.

    ``of`` names the texts, or arrays of annotated tokens; the column goes.
    Null has no match.
    """
    compiled = [token_patterns(patterns, kind) for patterns, kind in sets]
    annotated = df.schema[of].dataType.typeName() == "array"
    rest = [c for c in df.columns if c != of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(compiled)
        read = _reader(automaton)
        fields = ("text", "lower", "lemma", "pos", "ent", "like_num", "is_punct")

        def of_tokens(tokens: list[dict[str, Any]]) -> tuple[list[str], list[int]]:
            if len(automaton.places) > MOST or len(automaton.of_token) > MOST:
                automaton.clear()
            return [t["text"] + " " for t in tokens], [automaton.class_of(tuple(t[f] for f in fields)) for t in tokens]

        for batch in batches:
            found = []
            for value in batch.column(0):
                if not value.is_valid:
                    found.append([])
                    continue
                raw, kinds = (of_tokens if annotated else read)(value.as_py())
                found.append([{"set": s, "start": start, "n": n, "pattern": p, "match_string": "".join(raw[start : start + n]).rstrip(" ")}
                              for s, start, n, p in automaton.first_matches(kinds)])
            yield _rows(batch, found)

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest], f"_found {FOUND}"])
    return df.select(of, *rest).mapInArrow(run, schema)
