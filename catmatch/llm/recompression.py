"""Locally consistent parsing by recompression: runs and pairs of symbols get names, round by round.

Round 0 names every maximal run of one word. Every later round splits the symbols into left
and right ones by a coin thrown from the name, and names each adjacent (left, right) pair. Names
are functions of what they name, so equal stretches of any two texts get equal names in every
task, but for symbols at their ends, whose neighbours outside may take part.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

from catmatch.llm.words import join_names, mix

ROUNDS = 5
#: Symbols that a window should have to choose its anchor from.
FEW = 1


class Anchors(NamedTuple):
    """Stretches of windows that share an anchor, in text order."""
    window: np.ndarray  # where a stretch of window starts begins
    end: np.ndarray  # and where it ends (exclusive)
    name: np.ndarray  # of the anchor symbol


def _name_runs(names: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the maximal runs, and where they start."""
    at = np.flatnonzero(opens | np.r_[True, names[1:] != names[:-1]])
    lengths = np.diff(np.r_[at, len(names)])
    runs = names[at]
    long = lengths > 1
    runs[long] = join_names(runs[long], lengths[long].astype(np.uint64))
    return runs, at


def window_anchors(words: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS, few: int = FEW) -> Anchors:
    """For every window of consecutive words of one text, its anchor: a symbol that any equal window has too.

    words: hashes of the words of several texts, one after another; first: where texts begin.
    Per window, the symbols that no neighbour outside can change are followed from round to
    round. The anchor is the one of the smallest scrambled name in the last round that leaves
    at least `few` of them, or else in the first round that has any. So equal windows have
    anchors of one name at one place in them, wherever they stand.
    """
    n = len(words)
    bounds = np.r_[first, n].astype(np.int64)
    opens = np.zeros(n, bool)
    opens[first] = True
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(starts):
        return Anchors(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    anchor_name, anchor_at = words[starts].copy(), starts.copy()

    # Round 0: the first and the last run of a window may go on outside.
    names, at = _name_runs(words, opens)
    opens = opens[at]
    run_of = np.zeros(n, np.int64)
    run_of[at] = 1
    run_of = np.cumsum(run_of) - 1
    low, high = run_of[starts] + 1, run_of[starts + window - 1]
    live = np.arange(len(starts))

    def choose(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if not len(which):
            return
        spans = np.minimum(np.diff(np.r_[at, n]), 255).astype(np.uint64)
        order = ((np.uint64(255) - spans) << np.uint64(56)) | (mix(names, 50) >> np.uint64(8))
        best, least = low, order[low]
        for step in range(1, int((high - low).max())):
            here = np.minimum(low + step, high - 1)
            value = order[here]
            better = value < least
            best, least = np.where(better, here, best), np.where(better, value, least)
        anchor_name[which], anchor_at[which] = names[best], at[best]

    some = low < high  # a window of one or two runs keeps its first word
    live, low, high = live[some], low[some], high[some]
    for round_ in range(rounds):
        right = (mix(names, 100 + round_) >> np.uint64(63)).astype(bool)
        new_low, new_high = low + right[low], high - ~right[high - 1]
        goes_on = new_high - new_low >= few  # a pair is two symbols here still, so this leaves at least one
        choose(live[~goes_on], low[~goes_on], high[~goes_on])
        live, low, high = live[goes_on], new_low[goes_on], new_high[goes_on]
        if not len(live):
            break
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~opens[1:]
        lefts = np.flatnonzero(pair)
        names = names.copy()
        names[lefts] = join_names(names[lefts], names[lefts + 1])
        keep = np.ones(len(names), bool)
        keep[lefts + 1] = False
        index = np.cumsum(keep) - 1
        low, high = index[low], index[high - 1] + 1
        names, at, opens = names[keep], at[keep], opens[keep]
    choose(live, low, high)
    change = np.r_[True, (anchor_at[1:] != anchor_at[:-1]) | (anchor_name[1:] != anchor_name[:-1]) | (np.diff(starts) != 1)]
    begin = np.flatnonzero(change)
    last = np.r_[begin[1:], len(starts)] - 1
    return Anchors(starts[begin], starts[last] + 1, anchor_name[begin])
