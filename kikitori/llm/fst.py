"""Weighted finite-state transducers: union, concatenation, closure, lazy composition, best paths by lazy determinization.

Weights are sums of named features, so they can be fitted: an arc carries a tuple of feature names, a weight vector gives
their values, and the best path is the one of the greatest sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

Arc = tuple[str | None, tuple[str, ...], tuple[str, ...], int]  # input (None: none), outputs, features, next state


class Fst:
    """States 0.., start 0. ``arcs[s]`` leave state s; ``finals`` accept."""

    def __init__(self) -> None:
        self.arcs: list[list[Arc]] = [[]]
        self.finals: set[int] = set()

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, at: int, symbol: str | None, outputs: Iterable[str], to: int, features: Iterable[str] = ()) -> None:
        self.arcs[at].append((symbol, tuple(outputs), tuple(features), to))

    def _take(self, other: Fst) -> int:
        """The other's states behind our own; returns the place of its start."""
        base = len(self.arcs)
        self.arcs += [[(i, o, f, base + n) for i, o, f, n in arcs] for arcs in other.arcs]
        return base


def symbols(choices: Iterable[str], outputs: Mapping[str, Sequence[str]] | None = None) -> Fst:
    """One of ``choices``; each writes what ``outputs`` gives for it, nothing by default."""
    f = Fst()
    end = f.state()
    for c in choices:
        f.arc(0, c, (outputs or {}).get(c, ()), end)
    f.finals = {end}
    return f


def writes(output: str, *features: str) -> Fst:
    """Reads nothing and writes one symbol."""
    f = Fst()
    end = f.state()
    f.arc(0, None, (output,), end, features)
    f.finals = {end}
    return f


def concat(*parts: Fst) -> Fst:
    f = Fst()
    ends = {0}
    for p in parts:
        at = f._take(p)
        for e in ends:
            f.arc(e, None, (), at)
        ends = {at + x for x in p.finals}
    f.finals = ends
    return f


def union(*parts: Fst) -> Fst:
    f = Fst()
    for p in parts:
        at = f._take(p)
        f.arc(0, None, (), at)
        f.finals |= {at + x for x in p.finals}
    return f


def star(part: Fst) -> Fst:
    f = Fst()
    at = f._take(part)
    f.arc(0, None, (), at)
    for x in part.finals:
        f.arc(at + x, None, (), 0)
    f.finals = {0}
    return f


class Composition:
    """The composition of several transducers, each on what the one before writes, made as far as it is read: states are
    tuples of states, the arcs of a state for a symbol are kept. Only the first may write features in the end; every machine
    reads something on each of its arcs (use :func:`without_empty`)."""

    def __init__(self, *machines: Fst) -> None:
        self.machines = machines
        self.by_input: list[list[dict[str, list[tuple[tuple[str, ...], tuple[str, ...], int]]]]] = []
        for m in machines:
            rows = []
            for arcs in m.arcs:
                own: dict[str, list[tuple[tuple[str, ...], tuple[str, ...], int]]] = {}
                for i, o, f, n in arcs:
                    own.setdefault(i, []).append((o, f, n))
                rows.append(own)
            self.by_input.append(rows)
        self.start = (0,) * len(machines)
        self.kept: dict = {}

    def is_final(self, state: tuple[int, ...]) -> bool:
        return all(s in m.finals for s, m in zip(state, self.machines))

    def arcs(self, state: tuple[int, ...], symbol: str) -> list[tuple[tuple[str, ...], tuple[int, ...]]]:
        """(features, next state) for everything the cascade may do with a symbol."""
        key = (state, symbol)
        if (got := self.kept.get(key)) is None:
            got = self.kept[key] = list(dict.fromkeys((f, n) for f, n in self._run(0, state, (symbol,))))
        return got

    def _run(self, stage: int, state: tuple[int, ...], string: tuple[str, ...]):
        """Ways of the machines from ``stage`` on to read ``string``."""
        if stage == len(self.machines) or not string:
            return [((), state)]
        ways = [((), (), state[stage])]
        for symbol in string:
            ways = [(o + o2, f + f2, to) for o, f, at in ways for o2, f2, to in self.by_input[stage][at].get(symbol, ())]
        out = []
        for o, f, to in dict.fromkeys(ways):
            here = (*state[:stage], to, *state[stage + 1 :])
            out += [(f + f2, n) for f2, n in self._run(stage + 1, here, o)]
        return out


def without_empty(f: Fst) -> Fst:
    """The same relation without arcs that read and write nothing; arcs that read nothing but write are moved into the arc
    before them. No cycle of arcs without input may write."""
    closures: list[list[tuple[int, tuple[str, ...], tuple[str, ...]]]] = []
    for s in range(len(f.arcs)):
        seen: dict[tuple[int, tuple[str, ...], tuple[str, ...]], None] = {(s, (), ()): None}
        todo = [(s, (), ())]
        while todo:
            at, o, g = todo.pop()
            for i, o2, g2, n in f.arcs[at]:
                if i is None and (item := (n, o + o2, g + g2)) not in seen:
                    seen[item] = None
                    todo.append(item)
        closures.append(list(seen))
    out = Fst()
    out.arcs = [[] for _ in range(len(f.arcs) + 1)]
    shift = 1  # a new start, whose closure is taken by the arcs that leave it
    useful = [any(i is not None for i, *_ in arcs) for arcs in f.arcs]
    for s in range(len(f.arcs)):
        for i, o, g, n in f.arcs[s]:
            if i is None:
                continue
            for to, o2, g2 in closures[n]:
                if useful[to] or to in f.finals:
                    out.arc(s + shift, i, o + o2, to + shift, g + g2)
    for to, o, g in closures[0]:
        if o or g:
            raise ValueError("nothing may be written before the first symbol")
        out.arcs[0] += out.arcs[to + shift]
        if to in f.finals:
            out.finals.add(0)
    out.finals |= {s + shift for s in f.finals}
    return out


class BestPath:
    """Greatest weight of a path that reads a string. The composition is made deterministic as it is used: a state is the set
    of states with what each lags behind the best; steps are kept, so a symbol costs one look-up. With ``features`` their
    names come along."""

    def __init__(self, machine: Composition, weights: Mapping[str, float], features: bool = False, steps: int = 200_000) -> None:
        self.machine, self.features, self.limit = machine, features, steps
        self.weights = {f: int(round(w * 1000)) for f, w in weights.items()}
        self.cache: dict = {}
        self.ends: dict = {}

    def _step(self, state, symbol: str):
        best: dict = {}
        for s, lag, own in state:
            for f, n in self.machine.arcs(s, symbol):
                v = lag + sum(self.weights.get(x, 0) for x in f)
                if n not in best or v > best[n][0]:
                    best[n] = (v, own + f if self.features else ())
        top = max((v for v, _ in best.values()), default=0)
        got = (tuple((n, v - top, f) for n, (v, f) in sorted(best.items())), top)
        if len(self.cache) >= self.limit:
            self.cache.clear()
        self.cache[(state, symbol)] = got
        return got

    def read(self, string: Sequence[str]) -> tuple[float, tuple[str, ...]]:
        state, total = ((self.machine.start, 0, ()),), 0
        for symbol in string:
            state, gained = self.cache.get((state, symbol)) or self._step(state, symbol)
            if not state:
                return 0.0, ()
            total += gained
        ends = [(lag, f) for s, lag, f in state if self.machine.is_final(s)]
        if not ends:
            return 0.0, ()
        lag, names = max(ends, key=lambda x: x[0])
        return (total + lag) / 1000, names
