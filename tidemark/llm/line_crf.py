"""A linear-chain random field over the lines of a text: each line is good or bad, given itself and its neighbours.

Lines are described by small codes (shares of upper case, digits, symbols and repeats, sizes, copies of earlier lines).
A line's score adds up weights of its own codes and of those of the line before and after it; a two by two table joins
labels of neighbouring lines.  Forward-backward runs over all texts of a batch at once, line number by line number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidemark.llm.arrays import flat, mix, words

#: Codes of each feature are below this.
CODES = 8
SHARES = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6)
COUNTS = (0, 1, 2, 5, 10, 25, 80)
LENGTHS = (0.0, 2.0, 3.0, 4.0, 5.5, 8.0, 12.0)
N_FEATURES = 13


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
LETTER = UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
LETTER[0xC0:] = True  # the first byte of a character beyond ASCII
SYMBOL, STOP = _bytes("#*$%&|<>@~^_=+\\{}[]/"), _bytes(".,;:?")
SHOUT, CLOSE = _bytes("!"), _bytes(".!?:;\"'")
CHAR = np.ones(256, bool)
CHAR[0x80:0xC0] = False


@dataclass
class Lines:
    """Codes of lines, their length in characters, and n + 1 bounds of each text's lines."""

    codes: np.ndarray
    chars: np.ndarray
    first: np.ndarray


def describe(column: pa.Array | pa.ChunkedArray) -> Lines:
    """Lines of each text, split at line feeds.  A text without any, an empty or a null one is one line."""
    data, bounds = flat(column)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    text = np.searchsorted(breaks, bounds)
    first = np.concatenate([[0], np.cumsum(np.diff(text) + 1)])
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    ends = np.append(starts[1:], 0) - 1
    ends[first[1:] - 1] = bounds[1:]

    def count(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return upto[ends] - upto[starts]

    w, n = words(data, bounds), len(starts)
    line = np.searchsorted(starts, w.start, "right") - 1
    n_words = np.bincount(line, minlength=n)
    again = np.zeros(len(line), bool)
    if len(line):
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    _, found = np.unique(mix(w.hash ^ mix(line.astype(np.uint64))), return_index=True)
    distinct = np.bincount(line[found], minlength=n)
    head = np.searchsorted(line, np.arange(n + 1))
    place = np.arange(len(line)) - head[line]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash + place.astype(np.uint64)), dtype=np.uint64)])
    name = mix((upto[head[1:]] - upto[head[:-1]]) ^ mix(of.astype(np.uint64)))
    _, at, which = np.unique(name, return_index=True, return_inverse=True)
    copied = (at[which.reshape(-1)] < np.arange(n)) & (n_words > 0)
    last = np.where(ends > starts, ends - 1, 0)
    closed = np.where(ends > starts, CLOSE[data[last]] if len(data) else False, False)
    lone = np.bincount(line[w.end - w.start == 1], minlength=n)

    chars, some = count(CHAR), np.maximum(n_words, 1)
    letters, size = count(LETTER), np.maximum(chars, 1)
    shares = [
        count(UPPER) / np.maximum(letters, 1), count(DIGIT) / size, count(SYMBOL) / size, count(SHOUT) / size, count(STOP) / some,
        np.bincount(line[again], minlength=n) / some, (n_words - distinct) / some, lone / some, 1 - letters / size,
    ]
    codes = [np.searchsorted(SHARES, s, "left") for s in shares]
    codes += [np.searchsorted(COUNTS, n_words, "left"), np.searchsorted(LENGTHS, chars / some, "left"), copied, closed]
    return Lines(np.stack(codes, 1).astype(np.uint8), chars, first)


class Weights:
    """Weights of codes of the line, the one before and the one after; of the ends of a text; of neighbouring labels."""

    SIZE = 3 * N_FEATURES * CODES + 2 + 4

    def __init__(self, flat: np.ndarray):
        self.codes = flat[: 3 * N_FEATURES * CODES].reshape(3, N_FEATURES, CODES)
        self.edges = flat[-6:-4]
        self.pairs = flat[-4:].reshape(2, 2)

    def scores(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How much each line looks good rather than bad."""
        own, before, after = (sum(w[j][codes[:, j]] for j in range(N_FEATURES)) for w in self.codes)
        inner = np.ones(len(codes), bool)
        inner[first[:-1]] = False
        out = own.copy()
        out[1:] += np.where(inner[1:], before[:-1], 0)
        out[:-1] += np.where(inner[1:], after[1:], 0)
        out[first[:-1]] += self.edges[0]
        out[first[1:] - 1] += self.edges[1]
        return out


def forward_backward(scores: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums over labels up to each line and from it on, by its label (bad, good); log sum of each text."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, end, size = first[:-1][order], first[1:][order] - 1, size[order]
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts with at least that many lines
    ahead, behind = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    ahead[start, 1] = scores[start]
    for t in range(1, longest):
        at = start[: going[t]] + t
        p = ahead[at - 1]
        for label in (0, 1):
            ahead[at, label] = np.logaddexp(p[:, 0] + pairs[0, label], p[:, 1] + pairs[1, label])
        ahead[at, 1] += scores[at]
    for t in range(1, longest):
        at = end[: going[t]] - t
        bad, good = behind[at + 1, 0], behind[at + 1, 1] + scores[at + 1]
        for label in (0, 1):
            behind[at, label] = np.logaddexp(bad + pairs[label, 0], good + pairs[label, 1])
    last = ahead[first[1:] - 1]
    return ahead, behind, np.logaddexp(last[:, 0], last[:, 1])


def marginals(scores: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    ahead, behind, total = forward_backward(scores, first, pairs)
    return np.exp(ahead[:, 1] + behind[:, 1] - np.repeat(total, np.diff(first)))


def loss_and_slope(flat_weights: np.ndarray, codes: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of texts whose lines all have the label of the text, per line of each, and its gradient."""
    weights = Weights(flat_weights)
    scores, size = weights.scores(codes, first), np.diff(first)
    ahead, behind, total = forward_backward(scores, first, weights.pairs)
    each = 1.0 / size
    label = np.repeat(good, size)
    own = np.add.reduceat(scores, first[:-1]) if len(size) else np.zeros(0)
    seen = np.where(good, own, 0) + (size - 1) * np.where(good, weights.pairs[1, 1], weights.pairs[0, 0])
    loss = float((each * (total - seen)).sum())
    share, of = np.repeat(each, size), np.repeat(total, size)
    rest = share * (np.exp(ahead[:, 1] + behind[:, 1] - of) - label)
    inner = np.ones(len(codes), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    slope = np.zeros(Weights.SIZE)
    into = Weights(slope)
    for j in range(N_FEATURES):
        into.codes[0, j] += np.bincount(codes[:, j], rest, CODES)
        into.codes[1, j] += np.bincount(codes[at - 1, j], rest[at], CODES)
        into.codes[2, j] += np.bincount(codes[at, j], rest[at - 1], CODES)
    into.edges[:] = rest[first[:-1]].sum(), rest[first[1:] - 1].sum()
    for a in (0, 1):
        for b in (0, 1):
            both = ahead[at - 1, a] + weights.pairs[a, b] + behind[at, b] + (scores[at] if b else 0) - of[at]
            into.pairs[a, b] += (share[at] * np.exp(both)).sum()
        into.pairs[a, a] -= (each * (size - 1))[good == a].sum()
    return loss, slope


def minimise(function, start: np.ndarray, calls: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; `function` gives value and gradient."""
    x, (value, slope) = start, function(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < calls and np.abs(slope).max() > 1e-4:
        way, kept = slope.copy(), []
        for s, y in reversed(moves):
            a = s @ way / (s @ y)
            kept.append(a)
            way -= a * y
        if moves:
            s, y = moves[-1]
            way *= s @ y / (y @ y)
        for (s, y), a in zip(moves, reversed(kept)):
            way += s * (a - y @ way / (s @ y))
        step = 1.0 if moves else min(1.0, 1.0 / np.abs(slope).max())
        while used < calls:
            trial, used = x - step * way, used + 1
            new, new_slope = function(trial)
            if new <= value - 1e-4 * step * (slope @ way):
                break
            step /= 2
        else:
            break
        s, y = trial - x, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-memory:]
        x, value, slope = trial, new, new_slope
    return x
