"""A run-length index: run-compressed Burrows-Wheeler transform, suffix samples at run ends, matching statistics.

The text is an array of small integers in which 0 ends each part. ``matching_statistics`` streams patterns from
their last symbol to their first, all of them in step: a pattern keeps one row of the transform, the text position
it stands for and the length matched so far. Where the row's run has the wanted symbol, the row follows the
last-to-first mapping; otherwise it jumps to the nearest run end above or below that has it, whichever shares more
with the match so far, and the samples there give the new position.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, text: np.ndarray):
        text = np.append(text, 0) if len(text) == 0 or text[-1] else text
        self.symbols, codes = np.unique(text, return_inverse=True)
        size = len(text)
        # Each end is a symbol of its own, so that no match or order goes past it.
        ends = np.flatnonzero(text == 0)
        codes = codes + len(ends) - 1
        codes[ends] = np.arange(len(ends))
        self.base = len(ends) - 1
        order = self._sorted(codes, size)
        before = codes[order - 1]
        new = np.append(True, before[1:] != before[:-1])
        self.starts = np.flatnonzero(new)
        self.heads = before[self.starts]
        lengths = np.diff(np.append(self.starts, size))
        # Samples: the text positions of the rows at both ends of every run.
        self.first = order[self.starts]
        self.last = order[self.starts + lengths - 1]
        # Runs by symbol, and where the first row of each run goes.
        self.by_symbol = np.argsort(self.heads, kind="stable")
        self.next = np.empty(len(self.starts), np.int64)
        self.next[self.by_symbol] = np.cumsum(lengths[self.by_symbol]) - lengths[self.by_symbol]
        self.lengths = lengths
        self.keys = self.heads[self.by_symbol] * np.int64(len(self.starts) + 1) + self.by_symbol
        # A directory of the rows: which run each lies in.
        self.run_of = np.repeat(np.arange(len(self.starts), dtype=np.int32), lengths)

    def _sorted(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The order of the suffixes, by prefixes of 2, 4, 8, ... symbols; only those still alike are sorted again.

        ``levels`` keeps, for each of these widths, numbers that are equal where the prefixes are.
        """
        following = np.append(codes[1:], 0)
        keys = codes * np.int64(codes.max() + 1) + following
        self.levels = [codes.astype(np.int32)]
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        ranks = np.empty(size, np.int64)
        ranks[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
        self.levels.append(ranks.astype(np.int32))
        width = 2
        while not new.all():
            # An end stands within no prefix that two suffixes share, so what follows lies in the text.
            slots = np.flatnonzero(~(new & np.append(new[1:], True)))
            alike = order[slots]
            keys = ranks[alike] * np.int64(size) + ranks[alike + width]
            again = np.argsort(keys)
            keys = keys[again]
            order[slots] = alike[again]
            new[slots] = np.append(True, keys[1:] != keys[:-1])
            ranks[order[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            width *= 2
            self.levels.append(ranks.astype(np.int32))
        return order

    def encoded(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols; -1 for those that the text lacks."""
        at = np.minimum(np.searchsorted(self.symbols, symbols), len(self.symbols) - 1)
        return np.where((self.symbols[at] == symbols) & (symbols != 0), at + self.base, -1)

    def shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b, exact up to ``most``."""
        total = np.zeros(len(a), np.int64)
        itself = np.flatnonzero(a == b)
        if len(itself):
            a, b = np.where(a == b, 0, a), np.where(a == b, 1, b)
        for level in range(min(len(self.levels) - 1, int(most).bit_length()), -1, -1):
            ranks = self.levels[level]
            # No prefix that two suffixes share reaches the end of the text.
            total += (ranks[a + total] == ranks[b + total]).astype(np.int64) << level
        total[itself] = most
        return total

    def matching_statistics(self, patterns: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each place of each pattern, patterns[bounds[i]:bounds[i + 1]], the longest match from there on."""
        codes = self.encoded(patterns)
        out = np.zeros(len(patterns), np.int64)
        # The longest patterns first, so that those at work are always a prefix.
        order = np.argsort(-np.diff(bounds), kind="stable")
        lengths, ends = np.diff(bounds)[order], bounds[1:][order]
        rows = np.zeros(len(order), np.int64)
        places = np.full(len(order), self.first[0])
        matched = np.zeros(len(order), np.int64)
        runs = len(self.starts)
        for step in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            active = int(np.searchsorted(-lengths, -step, side="right"))
            at = ends[:active] - step
            wanted = codes[at]
            row = rows[:active]
            run = self.run_of[row]
            hit = self.heads[run] == wanted
            gone = np.flatnonzero(wanted < 0)
            jump = np.flatnonzero(~hit & (wanted >= 0))
            follow = np.flatnonzero(hit)
            rows[follow] = self.next[run[follow]] + row[follow] - self.starts[run[follow]]
            places[follow] -= 1
            matched[follow] += 1
            matched[gone] = 0
            if len(jump):
                symbol, here, most = wanted[jump], places[jump], int(matched[jump].max())
                slot = np.searchsorted(self.keys, symbol * np.int64(runs + 1) + run[jump])
                up, down = np.maximum(slot - 1, 0), np.minimum(slot, runs - 1)
                above, below = self.by_symbol[up], self.by_symbol[down]
                nearest = np.concatenate([self.last[above], self.first[below]])
                reach = self.shared(np.concatenate([here, here]), nearest, most)
                from_above = np.where((slot > 0) & (self.heads[above] == symbol), reach[: len(jump)], -1)
                from_below = np.where((slot < runs) & (self.heads[below] == symbol), reach[len(jump) :], -1)
                go_up = from_above >= from_below
                matched[jump] = np.minimum(matched[jump], np.where(go_up, from_above, from_below)) + 1
                rows[jump] = np.where(go_up, self.next[above] + self.lengths[above] - 1, self.next[below])
                places[jump] = np.where(go_up, self.last[above], self.first[below]) - 1
            out[at] = matched[:active]
        return out
