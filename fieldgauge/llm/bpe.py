"""Merge rules of a byte-pair vocabulary, and a vectorised test whether two tokens may stand side by side.

A token sequence is the encoding of its text exactly if every two neighbours are: encoding the two tokens' text gives
the two tokens again. So the encoding of a prefix is fixed by its last token, and encoding is a relaxation over the
tokens that end at each place: one, and only one, is compatible with the last token before it.
Tokens are numbered by merge rank here.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << np.int64(40)


class PairRules:
    """`left`, `right`: the two parts a token was last merged from, itself if it is elementary; `pairs`: all merges."""

    def __init__(self, size: int):
        self.left, self.right = np.arange(size), np.arange(size)
        self.size = size
        self._merged: dict[tuple[int, int], int] = {}

    def add(self, left: int, right: int, token: int) -> None:
        self.left[token], self.right[token] = left, right
        self._merged[(left, right)] = token

    def freeze(self) -> "PairRules":
        """Sort the pairs for vectorised lookups."""
        keys = np.array([a * self.size + b for a, b in self._merged] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.tokens = np.array(list(self._merged.values()) or [0], np.int64)[order]
        return self

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.tokens[at], NONE)

    def compatible_one(self, a: int, b: int) -> bool:
        """Whether the merges inside a and b leave the border between them alone.

        The merges are undone from the latest backwards; `limit` is the earliest one undone, and a merge over the
        border that ranks before it would have come first.
        """
        limit = int(NONE)
        left, right = self.left, self.right
        while True:
            if self._merged.get((a, b), limit) < limit:
                return False
            # The later token is undone; an elementary one cannot be, then the other is.
            for side in ("a", "b") if a > b else ("b", "a"):
                if side == "a" and (part := int(right[a])) != a:
                    a, limit = part, a
                    break
                if side == "b" and (part := int(left[b])) != b:
                    b, limit = part, b + 1
                    break
            else:
                return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for arrays of pairs."""
        out = np.zeros(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NONE)
        while len(at):
            fine = self.merged(a, b) >= limit
            a, b, limit, at = a[fine], b[fine], limit[fine], at[fine]
            part_a, part_b = self.right[a], self.left[b]
            can_a, can_b = part_a != a, part_b != b
            undo_a = can_a & ((a > b) | ~can_b)
            done = ~can_a & ~can_b
            out[at[done]] = True
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, part_a, a), np.where(undo_a, b, part_b)
            keep = ~done
            a, b, limit, at = a[keep], b[keep], limit[keep], at[keep]
        return out
