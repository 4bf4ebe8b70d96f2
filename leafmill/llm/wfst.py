"""Small weighted finite-state transducers, made whole over a fixed alphabet or lazily, with composition."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple


class Arc(NamedTuple):
    to: int
    out: str
    weight: float


class Transducer:
    """Deterministic on its input: ``arcs[state][symbol]``; a symbol without an arc passes and leads to ``rest[state]``."""

    def __init__(self, arcs: list[dict[str, Arc]], rest: list[int]) -> None:
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs[state].get(symbol) or Arc(self.rest[state], symbol, 1.0)

    def compose(self, after: Transducer, alphabet: Sequence[str]) -> Transducer:
        """One transducer that feeds this one's output to ``after``; weights multiply."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row: dict[str, Arc] = {}
            for symbol in alphabet:
                one = self.step(a, symbol)
                two = after.step(b, one.out)
                to = (one.to, two.to)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[symbol] = Arc(number[to], two.out, one.weight * two.weight)
            arcs.append(row)
        return Transducer(arcs, [0] * len(arcs))


def window(triggers: str, span: int, marks: dict[str, Arc]) -> Transducer:
    """After any of ``triggers``, for ``span`` symbols, symbols in ``marks`` are put out with their marks and weights (``to`` is ignored)."""
    arcs: list[dict[str, Arc]] = []
    for left in range(span + 1):
        row = {t: Arc(span, t, 1.0) for t in triggers}
        if left:
            row |= {s: Arc(left - 1, a.out, a.weight) for s, a in marks.items()}
        arcs.append(row)
    return Transducer(arcs, [max(0, left - 1) for left in range(span + 1)])


def latch(triggers: str, marks: dict[str, Arc]) -> Transducer:
    """After any of ``triggers``, to the end of the clause, symbols in ``marks`` are put out with their weights."""
    return Transducer([{t: Arc(1, t, 1.0) for t in triggers}, {s: Arc(1, a.out, a.weight) for s, a in marks.items()}], [0, 1])


class Pattern(NamedTuple):
    """Symbols that follow each other with up to ``gap`` others between two of them; the last one is put out as ``out`` with ``weight``."""

    steps: tuple[str, ...]  # each a set of symbols
    gap: int
    out: str
    weight: float
    begins: bool = False  # the first step must be a clause's first symbol

    def rank(self) -> tuple:
        return len(self.steps), self.weight, self.out


class Matcher:
    """Puts out the last symbol of each match of ``patterns`` as the longest pattern that ends there says (of several, the heaviest), all others as they are; determinised lazily.

    A state is a set of matches under way: pattern, steps made, symbols that may
    still stand before the next.
    """

    def __init__(self, patterns: Sequence[Pattern]) -> None:
        self.patterns = patterns
        self.sets: list[frozenset] = [frozenset((p, 0, 0) for p in range(len(patterns)))]
        self.number = {self.sets[0]: 0}
        self.anywhere = frozenset((p, 0, 0) for p, x in enumerate(patterns) if not x.begins)
        self.moves: dict[tuple[int, str], Arc] = {}

    def step(self, state: int, symbol: str) -> Arc:
        if (move := self.moves.get((state, symbol))) is None:
            under_way, ended = set(self.anywhere), None
            for p, made, left in self.sets[state]:
                x = self.patterns[p]
                if symbol in x.steps[made]:
                    if made + 1 == len(x.steps):
                        ended = x if ended is None or x.rank() > ended.rank() else ended
                    else:
                        under_way.add((p, made + 1, x.gap))
                if made and left:
                    under_way.add((p, made, left - 1))
            to = frozenset(under_way)
            if to not in self.number:
                self.number[to] = len(self.sets)
                self.sets.append(to)
            self.moves[state, symbol] = move = Arc(self.number[to], ended.out if ended else symbol, ended.weight if ended else 1.0)
        return move


class Cascade:
    """Transducers composed lazily: each feeds its output to the next, weights multiply; moves are kept, up to a bound."""

    MOST = 200_000

    def __init__(self, *parts: Transducer | Matcher) -> None:
        self.parts, self.start = parts, (0,) * len(parts)
        self.moves: dict[tuple[tuple, str], tuple[tuple, str, float]] = {}

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        if (move := self.moves.get((state, symbol))) is None:
            to, out, weight = [], symbol, 1.0
            for part, at in zip(self.parts, state):
                arc = part.step(at, out)
                out, weight = arc.out, weight * arc.weight
                to.append(arc.to)
            if len(self.moves) >= self.MOST:
                self.moves.clear()
            self.moves[state, symbol] = move = tuple(to), out, weight
        return move
