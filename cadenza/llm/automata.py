"""Grammar inference: probabilistic deterministic automata from strings, by merging prefix-tree states.

A state's evidence is the marginal likelihood of what its strings do there: whether they stop (a beta prior),
and which symbol follows - either drawn as in the whole sample, or from a distribution of the state's own
(a sparse Dirichlet prior). Two states merge if the states that must merge with them, those reached by the
same strings, are together likelier as one, given that each state costs `STATE` beforehand. So a few strings
merge states only as far as they speak for it, and many keep them apart.

States are merged in two rounds: first those as many symbols from the start, which turns the tree into the
sequence of a format's places; then states of different places, which makes loops where a length doesn't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import exp, lgamma, log

#: What a state costs beforehand (nats), and how many accepted states, nearest first, another is held against.
STATE, LOOK = 3.0, 4


@dataclass
class Automaton:
    """moves[state][symbol] = (next state, log probability); onward[state]: where other symbols lead; stops[state]
    = log probability. Floor: of a symbol that no training string has."""

    moves: list[dict[str, tuple[int, float]]]
    onward: list[int]
    stops: list[float]
    floor: float

    def log_likelihood(self, text: str) -> float:
        """Natural log probability of the whole string."""
        state, total, moves = 0, 0.0, self.moves
        for symbol in text:
            step = moves[state].get(symbol)
            if step:
                state = step[0]
                total += step[1]
            else:
                state = self.onward[state]
                total += self.floor
        return total + self.stops[state]


@lru_cache(maxsize=1 << 16)
def _rising(n: int, start: float) -> float:
    """log of start (start + 1) ... (start + n - 1)."""
    return lgamma(n + start) - lgamma(start)


class _States:
    """Symbol counts, stops and moves of states. `whole`: log share of each symbol in the sample."""

    def __init__(self, samples: Sequence[str]):
        self.counts: list[dict[str, int]] = [{}]
        self.stop, self.next = [0], [{}]
        total: dict[str, int] = {}
        for text in samples:
            state = 0
            for symbol in text:
                total[symbol] = total.get(symbol, 0) + 1
                self.counts[state][symbol] = self.counts[state].get(symbol, 0) + 1
                to = self.next[state].get(symbol)
                if to is None:
                    to = self.next[state][symbol] = len(self.next)
                    self.counts.append({})
                    self.stop.append(0)
                    self.next.append({})
                state = to
            self.stop[state] += 1
        self.size = max(len(total), 1)
        seen = sum(total.values())
        self.whole = {s: log((n + 0.5) / (seen + 0.5 * self.size)) for s, n in sorted(total.items())}

    def emissions(self, counts: dict[str, int]) -> tuple[float, float]:
        """Log likelihoods of symbols as in the whole sample, and from a distribution of the state's own."""
        alpha, n = 1 / self.size, sum(counts.values())
        return sum(c * self.whole[s] for s, c in counts.items()), sum(_rising(c, alpha) for c in counts.values()) - _rising(n, 1.0)

    def evidence(self, counts: dict[str, int], stop: int) -> float:
        same, own = self.emissions(counts)
        go, top = sum(counts.values()), max(same, own)
        return _rising(stop, 0.5) + _rising(go, 0.5) - _rising(stop + go, 1.0) + top + log(0.5 * (exp(same - top) + exp(own - top)))

    def own_evidence(self, state: int) -> float:
        return self.evidence(self.counts[state], self.stop[state])

    def merged(self, a: int, b: int) -> tuple[float, dict[int, int], dict[int, tuple]]:
        """What merging two states (and those that must follow) gains, whom each merged state stands for, and the merged ones' content."""
        root: dict[int, int] = {}
        made: dict[int, tuple] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        def content(x: int) -> tuple:
            return made.get(x) or (self.counts[x], self.stop[x], self.next[x], self.own_evidence(x))

        todo, gain = [(a, b)], 0.0
        while todo:
            a, b = map(find, todo.pop())
            if a == b:
                continue
            if b < a:
                a, b = b, a
            (counts, stop, moves, value), (more, stop_b, moves_b, value_b) = content(a), content(b)
            counts, moves = dict(counts), dict(moves)
            for s, n in more.items():
                counts[s] = counts.get(s, 0) + n
            follow = set()
            for s, to in moves_b.items():
                if s in moves:
                    follow.add((moves[s], to))
                else:
                    moves[s] = to
            todo += sorted(follow)
            root[b] = a
            one = self.evidence(counts, stop + stop_b)
            made[a] = counts, stop + stop_b, moves, one
            made.pop(b, None)
            gain += one - value - value_b + STATE
        return gain, {x: find(x) for x in root}, made

    def commit(self, made: dict[int, tuple]) -> None:
        for x, (counts, stop, moves, _) in made.items():
            self.counts[x], self.stop[x], self.next[x] = counts, stop, moves

    def fold_places(self) -> None:
        """Merge states of the same distance from the start, the most used ones first."""
        layer = [0]
        while layer:
            edges = sorted({t for q in layer for t in self.next[q].values()}, key=lambda t: (-sum(self.counts[t].values()) - self.stop[t], t))
            kept: list[int] = []
            for state in edges:
                for other in kept:
                    gain, stands, made = self.merged(other, state)
                    if gain > 0:
                        self.commit(made)
                        kept = [stands.get(q, q) for q in kept]
                        for q in layer:
                            self.next[q] = {s: stands.get(t, t) for s, t in self.next[q].items()}
                        for x in made:
                            self.next[x] = {s: stands.get(t, t) for s, t in self.next[x].items()}
                        break
                else:
                    kept.append(state)
            layer = list(dict.fromkeys(kept))

    def fold_loops(self) -> list[int]:
        """Merge states of different places; returns the accepted ones."""
        accepted = [0]
        while True:
            waiting = [(-sum(self.counts[t].values()) - self.stop[t], k, t) for k, q in enumerate(accepted) for t in sorted(set(self.next[q].values())) if t not in accepted]
            if not waiting:
                return accepted
            _, k, state = min(waiting)
            for other in dict.fromkeys([accepted[k], *accepted[::-1][:LOOK]]):
                gain, stands, made = self.merged(other, state)
                if gain > 0:
                    self.commit(made)
                    for q in range(len(self.next)):
                        if q not in stands and any(t in stands for t in self.next[q].values()):
                            self.next[q] = {s: stands.get(t, t) for s, t in self.next[q].items()}
                    accepted = list(dict.fromkeys(stands.get(q, q) for q in accepted))
                    break
            else:
                accepted.append(state)


def infer(samples: Sequence[str], *, floor: float = 1e-4) -> Automaton:
    """The automaton of these strings; an empty list gives one that finds everything unlikely."""
    if not samples:
        return Automaton([{}], [0], [log(floor)], log(floor))
    states = _States(sorted(samples))
    states.fold_places()
    accepted = states.fold_loops()
    number = {state: k for k, state in enumerate(accepted)}
    alpha = 1 / states.size
    moves, onward, stops = [], [], []
    for state in accepted:
        counts, stop = states.counts[state], states.stop[state]
        go = sum(counts.values())
        same, own = states.emissions(counts)
        as_whole = 1 / (1 + exp(min(own - same, 700)))
        goes = log((go + 0.5) / (go + stop + 1))
        main = number[states.next[state][min(counts, key=lambda s: (-counts[s], s))]] if counts else number[state]
        onward.append(main)
        moves.append({s: (number[states.next[state][s]] if s in counts else main, goes + log(as_whole * exp(w) + (1 - as_whole) * (counts.get(s, 0) + alpha) / (go + 1))) for s, w in states.whole.items()})
        stops.append(log((stop + 0.5) / (go + stop + 1)))
    return Automaton(moves, onward, stops, log(floor))
