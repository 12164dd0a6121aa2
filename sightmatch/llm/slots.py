"""A minimal perfect hash over 128-bit digests, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

#: Positions per key still to be placed, and the most rounds; distinct keys need some 20 at most.
ROOM, MOST_ROUNDS = 2, 64


class SlotTable:
    """Slots 0 to n-1 for n distinct keys, an array of (n, 2) unsigned 64-bit numbers.

    In each round the keys left hash into an array; those alone in their position are marked
    there, the others go on to the next round. A key's slot is the number of marks before its own. The
    key of each slot is kept, so that a lookup is verified and keys that were not given are found out.
    """

    def __init__(self, keys: np.ndarray):
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = np.empty_like(keys)
        rest, before = keys, 0
        while len(rest):
            if len(self.rounds) == MOST_ROUNDS:
                raise ValueError("two keys are equal: a digest stands for two different nodes")
            room = ROOM * len(rest) + 1
            at = self._place(rest, len(self.rounds), room)
            alone = np.bincount(at, minlength=room) == 1
            ranks = before + np.cumsum(alone) - 1
            placed = alone[at]
            self.keys[ranks[at[placed]]] = rest[placed]
            self.rounds.append((alone, ranks))
            before += int(alone.sum())
            rest = rest[~placed]

    @staticmethod
    def _place(keys: np.ndarray, round_: int, room: int) -> np.ndarray:
        mixed = keys[:, 0] + np.uint64(2 * round_ + 1) * keys[:, 1]
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(room)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is not in the table."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (alone, ranks) in enumerate(self.rounds):
            at = self._place(keys[left], k, len(alone))
            here = alone[at]
            slot = ranks[at[here]]
            same = (self.keys[slot] == keys[left[here]]).all(axis=1)
            slots[left[here][same]] = slot[same]
            left = left[~here]
        return slots
