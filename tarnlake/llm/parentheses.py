"""Trees as balanced parentheses: subtree ends by range min-max blocks, leaf counts by rank."""

from __future__ import annotations

import numpy as np

#: Parentheses of a block, and blocks below one node of the tree over them.
BLOCK = 256
FAN = 16


class Parentheses:
    """A forest in preorder, an opening parenthesis (true) and a closing one (false) for each node.

    The excess after a position is the opening minus the closing parentheses so far.  Of each block the least excess is kept, and of
    `FAN` blocks the least of theirs, and so on up.
    """

    def __init__(self, opening: np.ndarray):
        self.opening = opening
        self.excess = np.cumsum(np.where(opening, 1, -1))
        self.levels = [_least(self.excess, BLOCK)]
        while len(self.levels[-1]) > 1:
            self.levels.append(_least(self.levels[-1], FAN))
        #: Opening parentheses, and opening ones closed at once, before each position.
        self.opened = np.concatenate(([0], np.cumsum(opening)))
        self.leaves = np.concatenate(([0], np.cumsum(opening[:-1] & ~opening[1:])))

    def find_close(self, at: int) -> int:
        """Where the parenthesis opened at a position is closed: the next position of a lower excess."""
        want = int(self.excess[at]) - 1
        if not self.opening[at + 1]:
            return at + 1
        block = at // BLOCK
        found = self._in_block(at + 1, (block + 1) * BLOCK, want)
        if found >= 0:
            return found
        # Up from the next block, past siblings that stay above, to the first that goes as low; then down to it.
        level, node = 0, block + 1
        while True:
            siblings = self.levels[level][node : (node // FAN + 1) * FAN]
            hit = np.flatnonzero(siblings <= want)
            if len(hit):
                node += int(hit[0])
                break
            level, node = level + 1, node // FAN + 1
        while level:
            level, node = level - 1, node * FAN
            node += int(np.flatnonzero(self.levels[level][node : node + FAN] <= want)[0])
        return self._in_block(node * BLOCK, (node + 1) * BLOCK, want)

    def _in_block(self, start: int, end: int, want: int) -> int:
        hit = np.flatnonzero(self.excess[start:end] <= want)
        return start + int(hit[0]) if len(hit) else -1


def _least(values: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(values, np.arange(0, len(values), size)) if len(values) else values
