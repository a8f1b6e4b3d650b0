"""Per-worker memory of what a word becomes, for work that is the same for every copy of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache:
    """word -> value, filled many at a time; emptied when it reaches `limit` entries, so its size is bounded."""

    def __init__(self, fill: Callable[[list], Iterable], limit: int = 600_000):
        self.fill, self.limit, self.known = fill, limit, {}

    def get(self, words: list) -> list:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            missing = [w for w in set(words) if w not in known]
        if len(known) + len(missing) > self.limit:
            known.clear()
            missing = list(set(words))
        known.update(zip(missing, list(self.fill(missing))))
        return [known[w] for w in words]
