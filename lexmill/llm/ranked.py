"""Numbered lists of best rows inside a task."""

from __future__ import annotations

import numpy as np


class Best:
    """The best ``k`` rows of numbered lists: higher scores first, then smaller ids."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * lists
        self.scores = [np.zeros(0, np.int64)] * lists

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> int | None:
        """Take rows in; the lowest score of a full list."""
        ids = np.concatenate([self.ids[i], ids])
        scores = np.concatenate([self.scores[i], scores])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[keep], scores[keep]
        return int(scores[keep[-1]]) if len(keep) == self.k else None

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List number, id and score of all rows."""
        none = np.zeros(0, np.int64)
        sizes = [len(x) for x in self.ids]
        return (
            np.repeat(np.arange(len(sizes)), sizes),
            np.concatenate([*self.ids, none]),
            np.concatenate([*self.scores, none]),
        )
