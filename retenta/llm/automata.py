"""Probabilistic automata inferred from example strings by merging prefix-tree states.

The examples' prefix tree counts how often each state is reached, left by each letter and
ended in. In breadth-first order each state is compared with those already kept; two
states whose ending and leaving frequencies agree within a Hoeffding bound, recursively
along their letters, are merged (their subtrees are folded together). What stays is a
small automaton that accepts the examples' format and gives each string a likelihood.
"""

from __future__ import annotations

import math


class Automaton:
    """States are numbers, 0 is the start; ``arcs[state][letter] = [next state, count]``."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.arcs: list[dict[str, list[int]]] = [{}]
        self.ends: list[int] = [0]
        self.visits: list[int] = [0]
        for x in examples:
            at = 0
            self.visits[0] += 1
            for letter in x:
                arc = self.arcs[at].get(letter)
                if arc is None:
                    arc = self.arcs[at][letter] = [len(self.arcs), 0]
                    self.arcs.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                arc[1] += 1
                at = arc[0]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._compile()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for letter in self.arcs[a].keys() | self.arcs[b].keys():
                x, y = self.arcs[a].get(letter), self.arcs[b].get(letter)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b, which is still a tree, to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for letter, (to, count) in self.arcs[b].items():
                arc = self.arcs[a].get(letter)
                if arc is None:
                    self.arcs[a][letter] = [to, count]
                else:
                    arc[1] += count
                    todo.append((arc[0], to))

    def _merge(self) -> None:
        kept = [0]
        while True:
            known = set(kept)
            edge = min(((q, letter) for q in kept for letter, arc in self.arcs[q].items() if arc[0] not in known), default=None)
            if edge is None:
                return
            q, letter = edge
            state = self.arcs[q][letter][0]
            for other in kept:
                if self._compatible(other, state):
                    self.arcs[q][letter][0] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)

    def _compile(self) -> None:
        """Log2 probabilities of arcs and ends of the states that can be reached."""
        reach, todo = {0: 0}, [0]
        for q in todo:
            for to, _ in self.arcs[q].values():
                if to not in reach:
                    reach[to] = len(reach)
                    todo.append(to)
        total = [sum(c for _, c in self.arcs[q].values()) + self.ends[q] for q in todo]
        self.steps = [{x: (reach[to], math.log2(c / n)) for x, (to, c) in self.arcs[q].items()} for q, n in zip(todo, total)]
        self.stops = [math.log2(self.ends[q] / n) if self.ends[q] else None for q, n in zip(todo, total)]
        del self.arcs, self.ends, self.visits

    def score(self, x: str) -> float | None:
        """Log2 likelihood a letter, the end counted; None if the format excludes it."""
        at, total = 0, 0.0
        for letter in x:
            step = self.steps[at].get(letter)
            if step is None:
                return None
            at, total = step[0], total + step[1]
        return None if self.stops[at] is None else (total + self.stops[at]) / (len(x) + 1)
