"""Which grams a line must hold if it is to match a pattern.

A need is a tree: one gram, all of some needs, or one of some needs. It may ask
for less than the pattern does, never for more: what it lets through is verified
by the pattern itself."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np

from . import grams as G

#: texts that a part of a pattern may stand for before it counts as open
CHOICES = 32
#: characters of such a text
LENGTH = 64

_parser, _ops = re._parser, re._constants


@dataclass(frozen=True)
class Need:
    """``kind`` is gram (then ``gram`` is it), all or any (of ``parts``)."""

    kind: str
    gram: int = 0
    parts: tuple[Need, ...] = ()

    def met(self, lists: dict[int, np.ndarray]) -> np.ndarray:
        """The sorted numbers of lines that meet the need, shortest lists first."""
        if self.kind == "gram":
            return lists.get(self.gram, np.zeros(0, np.int64))
        if self.kind == "any":
            return reduce(np.union1d, (p.met(lists) for p in self.parts))
        out = None
        for part in sorted(self.parts, key=lambda p: p.most(lists)):
            out = part.met(lists) if out is None else np.intersect1d(out, part.met(lists), assume_unique=True)
            if not len(out):
                break
        return out

    def most(self, lists: dict[int, np.ndarray]) -> int:
        """How many lines can meet the need at most."""
        if self.kind == "gram":
            return len(lists.get(self.gram, ()))
        each = [p.most(lists) for p in self.parts]
        return sum(each) if self.kind == "any" else min(each)


def grams_in(need: Need) -> set[int]:
    return {need.gram} if need.kind == "gram" else set().union(*(grams_in(p) for p in need.parts))


def all_of(needs: Iterable[Need | None]) -> Need | None:
    some = list(dict.fromkeys(n for n in needs if n is not None))
    return None if not some else some[0] if len(some) == 1 else Need("all", parts=tuple(some))


def any_of(needs: Iterable[Need | None]) -> Need | None:
    some = list(dict.fromkeys(needs))
    return None if None in some or not some else some[0] if len(some) == 1 else Need("any", parts=tuple(some))


def literal_need(text: str) -> Need | None:
    """All grams of the text, without case; None for a text shorter than a gram."""
    plain = "".join(chr(c) for c in G.folded(np.array([ord(c) for c in text], np.uint32)))
    return all_of(Need("gram", g) for g in G.of_text(plain))


def regex_need(pattern: str) -> Need | None:
    """What a Python-style pattern needs; None if it can match without any gram."""
    try:
        return _Walk().closed(_parser.parse(pattern, re.IGNORECASE))
    except _Open:
        return None


class _Open(Exception):
    """The two dialects may read the pattern differently: nothing is promised."""


class _Walk:
    """Follows a parsed pattern, holding the texts that the part just passed may
    end with while there are few of them."""

    def closed(self, parsed) -> Need | None:
        needs, texts, whole = self.sequence(parsed)
        return all_of([*needs, self.of(texts)])

    def of(self, texts: set[str]) -> Need | None:
        return any_of(literal_need(t) for t in sorted(texts))

    def sequence(self, parsed) -> tuple[list[Need | None], set[str], bool]:
        """Needs so far, texts at the end, and whether these are all there is."""
        needs, texts, whole = [], {""}, True
        for op, value in parsed:
            more, ends, exact = self.node(op, value)
            needs += more
            if exact:
                both = {a + b for a in texts for b in ends}
                if len(both) <= CHOICES and max(map(len, both)) <= LENGTH:
                    texts = both
                    continue
            needs.append(self.of(texts))
            texts, whole = ends, False
        return needs, texts, whole

    def node(self, op, value) -> tuple[list[Need | None], set[str], bool]:
        """The same for one node. Texts that aren't all there is may be an end only."""
        if op is _ops.LITERAL:
            # control characters by letter mean classes in the other dialect
            return ([], {chr(value)}, True) if value >= 32 else ([], {""}, False)
        if op is _ops.IN:
            return self.choice(value)
        if op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            return [], {""}, True
        if op is _ops.SUBPATTERN:
            return self.sequence(value[3])
        if op is _ops.ATOMIC_GROUP:
            return self.sequence(value)
        if op is _ops.BRANCH:
            parts = [self.sequence(p) for p in value[1]]
            texts = set().union(*(t for _, t, _ in parts))
            if all(whole for _, _, whole in parts) and len(texts) <= CHOICES:
                return [], texts, True
            return [any_of(all_of([*n, self.of(t)]) for n, t, _ in parts)], {""}, False
        if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT):
            least, most, parsed = value
            needs, texts, whole = self.sequence(parsed)
            if whole and (least, most) in ((0, 1), (1, 1)):
                return [], texts | {""} if least == 0 else texts, True
            if least == 0:
                return [], {""}, False
            if whole and least == most and most <= LENGTH:
                out = {""}
                for _ in range(least):
                    out = {a + b for a in out for b in texts}
                    if len(out) > CHOICES or max(map(len, out)) > LENGTH:
                        return [self.of(texts)], texts, False
                return [], out, True
            return [*needs, self.of(texts)], texts, False
        return [], {""}, False

    def choice(self, items) -> tuple[list[Need | None], set[str], bool]:
        """A class of characters; a few are texts, others are open."""
        if any(kind is _ops.LITERAL and value in (ord("["), ord("&")) for kind, value in items):
            raise _Open  # a class within a class, or an intersection
        out: set[str] = set()
        for kind, value in items:
            if kind is _ops.LITERAL and value >= 32:
                out.add(chr(value))
            elif kind is _ops.RANGE and value[1] - value[0] < CHOICES and value[0] >= 32:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return [], {""}, False
        return ([], out, True) if len(out) <= CHOICES else ([], {""}, False)
