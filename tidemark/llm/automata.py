"""Probabilistic automata from examples: a prefix tree whose statistically compatible states are merged."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

FLOOR = -12.0  # log2 probability of a symbol that no state has ever seen


@dataclass
class Automaton:
    """moves[state][symbol] = (next state, log2 probability); overall[symbol] = log2 probability in any state."""

    moves: list[dict[str, tuple[int, float]]]
    overall: dict[str, float]

    def score(self, word: str) -> float:
        """Mean log2 probability of a symbol.  A symbol that the state hasn't seen costs one bit more than its overall
        probability, and the walk goes on from the start."""
        state, total = 0, 0.0
        for c in word:
            move = self.moves[state].get(c)
            if move:
                state = move[0]
                total += move[1]
            else:
                state = 0
                total += max(FLOOR, self.overall.get(c, FLOOR) - 1)
        return total / len(word) if word else FLOOR


def infer(words: Iterable[str], alpha: float = 0.05) -> Automaton:
    """States are compatible when the Hoeffding bound at `alpha` can't tell their frequencies apart, nor those below."""
    next_: list[dict[str, int]] = [{}]
    seen, ends = [0], [0]
    for w in sorted(words):
        q = 0
        seen[0] += 1
        for c in w:
            if c not in next_[q]:
                next_[q][c] = len(next_)
                next_.append({})
                seen.append(0)
                ends.append(0)
            q = next_[q][c]
            seen[q] += 1
        ends[q] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], seen[a], ends[b], seen[b]):
                return False
            for c in next_[a].keys() | next_[b].keys():
                x, y = next_[a].get(c), next_[b].get(c)
                if differ(seen[x] if x is not None else 0, seen[a], seen[y] if y is not None else 0, seen[b]):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def fold(a: int, b: int) -> None:
        """Add tree b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for c, y in next_[b].items():
                if c in next_[a]:
                    todo.append((next_[a][c], y))
                else:
                    next_[a][c] = y

    red = [0]
    while True:
        blue = next(((q, c, y) for q in red for c, y in sorted(next_[q].items()) if y not in red), None)
        if blue is None:
            break
        q, c, y = blue
        for r in red:
            if compatible(r, y):
                next_[q][c] = r
                fold(r, y)
                break
        else:
            red.append(y)
    number = {q: i for i, q in enumerate(red)}
    # Transition counts: after merging, what a state saw is spread over its symbols as it left them.
    used: list[dict[str, int]] = [dict.fromkeys(next_[q], 0) for q in red]
    leave = [0] * len(red)
    for w in words:
        i = 0
        for c in w:
            used[i][c] += 1
            leave[i] += 1
            i = number[next_[red[i]][c]]
    symbols: dict[str, int] = {}
    for table in used:
        for c, n in table.items():
            symbols[c] = symbols.get(c, 0) + n
    return Automaton(
        [
            {c: (number[next_[red[i]][c]], math.log2((n + 0.5) / (leave[i] + 0.5 * len(used[i])))) for c, n in used[i].items()}
            for i in range(len(red))
        ],
        {c: math.log2(n / sum(leave)) for c, n in symbols.items() if n},
    )
