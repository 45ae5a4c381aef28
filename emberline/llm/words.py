"""What word-based scorers share: words of texts as numbers of a table whose rows hold what is known of each distinct word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 250_000


class WordTable:
    """Remembers a vector of numbers for each distinct word; describe(words) makes the vectors of new words."""

    def __init__(self, describe: Callable[[list[str]], np.ndarray]) -> None:
        self.describe = describe
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: np.ndarray | None = None
        self.used = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """A matrix with a row for each word."""
        at = list(map(self.index.get, words))
        if None in at or self.rows is None:
            if len(self.index) > REMEMBERED:
                self._forget()
            new = list({x for x in words if x not in self.index})
            made = self.describe(new)
            if self.rows is None or self.used + len(new) > len(self.rows):
                grown = np.zeros((max(1024, 2 * (self.used + len(new))), made.shape[1]), dtype=np.float32)
                if self.rows is not None:
                    grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = made
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            at = list(map(self.index.__getitem__, words))
        return self.rows[np.array(at, dtype=np.int64)]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of rows; a run may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def maxima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maxima over runs; 0 for an empty run."""
    out = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.maximum.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def byte_counts(texts: list[bytes]) -> np.ndarray:
    """How often each byte occurs in each text."""
    return np.stack([np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) for x in texts]).astype(np.float64) if texts else np.zeros((0, 256))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: ends of steps, and rising values at them."""
    order = np.argsort(x, kind="stable")
    knots: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        knots.append([a, a, b, 1.0])
        while len(knots) > 1 and (knots[-2][2] * knots[-1][3] >= knots[-1][2] * knots[-2][3] or knots[-2][1] == knots[-1][0]):
            low, high, total, n = knots.pop()
            knots[-1][1] = max(knots[-1][1], high)
            knots[-1][2] += total
            knots[-1][3] += n
    return np.array([k[i] for k in knots for i in (0, 1)]), np.array([k[2] / k[3] for k in knots for _ in (0, 1)])
