"""A dictionary of words of scripts written without blanks, learned from counts over a whole corpus.

Every run of Thai, Chinese or Japanese characters is counted by all its substrings of up to ``GRAM``
characters, and by those that begin a text or follow an end mark. A substring is a word if it occurs often
enough, holds together (however it is split, its two parts stand side by side far more often than their
own counts would have it) and is free at both ends (the character next to it here isn't nearly always there). Counts are kept in tables of fixed width, so what is sent to the executors
does not grow with the corpus; a shared slot makes a word too many, and the mean of a table is taken off.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import slices
from .text import dense_counts, mix

#: Characters of the longest substring that is counted; a word has one less, so that its neighbours are known.
GRAM = 12
SLOTS, OPEN_SLOTS = 1 << 20, 1 << 18
#: The last counter is of all characters.
WIDTH = 2 * SLOTS + OPEN_SLOTS + 1
#: Occurrences of a word at least, and how many nats its parts cohere more than by chance.
LEAST_COUNT, COHESION = 5, 2.5
#: A substring whose neighbour is there in more than this share of cases is part of a longer word.
BOUND = 0.9
#: A word opens sentences if it is seen to in so many cases, and in this share of all.
LEAST_OPEN, OPEN_SHARE = 5, 0.25
#: Runs up to this length are remembered with their words.
KEPT_CHARS = 200
SPACELESS = "\u0e00-\u0e7f\u3005\u3040-\u30ff\u3400-\u9fff\uff66-\uff9f"
#: Runs with what stands before them: nothing, or an end mark and what closes it, shows where a sentence begins.
_RUN = re.compile(f"(?P<open>(?:^|[.!?。！？｡\\n]+[\"”’»」』）)]*)[ \\t\u3000\"“‘«「『（(]*)?(?P<run>[{SPACELESS}]+)")


def _hashes(c: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of a size, by their first character."""
    h = np.zeros(max(0, len(c) - size + 1), dtype=np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)])
    return h


def _slots(h: np.ndarray) -> np.ndarray:
    return np.stack([(h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS])


def _open_slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(OPEN_SLOTS - 1)).astype(np.int64) + 2 * SLOTS


def word_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often the substrings of all runs occur, and how often they open a sentence."""

    def count(batch):
        for _, group in slices(batch.column(0).to_pylist()):
            found = [(m["open"] is not None, m["run"]) for t in group for m in _RUN.finditer(t)]
            if not found:
                continue
            c = np.frombuffer("\n".join(r for _, r in found).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            sizes = np.array([len(r) for _, r in found])
            begins = np.cumsum(sizes + 1) - sizes - 1
            yield np.full(int(sizes.sum()), WIDTH - 1)
            opening = begins[np.array([o for o, _ in found])]
            for size in range(1, GRAM + 1):
                h = _hashes(c, size)
                clean = np.ones(len(h), dtype=bool)
                for k in range(size):
                    clean &= c[k : k + len(h)] != 10
                yield _slots(h[clean]).ravel()
                at = opening[opening < len(h)]
                yield _open_slots(h[at[clean[at]]])

    some = df.where(F.col(text).rlike("[\\x{0e00}-\\x{0e7f}\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]")).select(text)
    return dense_counts(some, WIDTH, count)


class Dictionary:
    """Paths through lattices of words: of given ones, and of those that counts show to be words."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        self.counts = counts
        if counts is not None:
            self.noise = float(counts[: 2 * SLOTS].mean())
            self.total = max(1.0, float(counts[WIDTH - 1]))
        self.kept = lru_cache(100_000)(self._cut)
        self.opens = lru_cache(100_000)(self._opens)

    def cut(self, run: str, given: frozenset[str]) -> tuple[str, ...]:
        """The words of a run; those of short runs are kept."""
        return self.kept(run, given) if len(run) <= KEPT_CHARS else self._cut(run, given)

    def _seen(self, h: np.ndarray) -> np.ndarray:
        return np.maximum(self.counts[_slots(h)].min(0) - self.noise, 0.0)

    def learned(self, run: str) -> np.ndarray:
        """Which substrings of a run are learned words: by size and first character."""
        c = np.frombuffer(run.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        logs = [None] + [np.log(self._seen(_hashes(c, n)) + 0.1) for n in range(1, GRAM + 1)]
        out = np.zeros((GRAM + 1, len(run)), dtype=bool)
        for n in range(2, min(GRAM - 1, len(run)) + 1):
            m = len(run) - n + 1
            parts = np.max([logs[k][:m] + logs[n - k][k : k + m] for k in range(1, n)], axis=0)
            out[n, :m] = (logs[n] >= np.log(LEAST_COUNT)) & (logs[n] + np.log(self.total) - parts >= COHESION)
            if m > 1:
                bound = logs[n + 1][: m - 1] > logs[n][: m - 1] + np.log(BOUND)
                out[n, : m - 1] &= ~bound
                bound = logs[n + 1][: m - 1] > logs[n][1:m] + np.log(BOUND)
                out[n, 1:m] &= ~bound
        return out

    def _opens(self, word: str) -> bool:
        """Whether a word opens sentences, as the counts show."""
        if self.counts is None or not 2 <= len(word) < GRAM:
            return False
        h = _hashes(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), len(word))
        first, all_ = float(self.counts[_open_slots(h)][0]), float(self._seen(h)[0])
        return first >= LEAST_OPEN and first >= OPEN_SHARE * all_

    def _cut(self, run: str, given: frozenset[str]) -> tuple[str, ...]:
        """The words of a run: fewest characters outside of words, then fewest words; a given word counts
        as a little less than one, so that it wins over a learned one of the same place."""
        n = len(run)
        longest = max(map(len, given), default=0)
        learned = self.learned(run) if self.counts is not None else None
        best: list[tuple[int, float, int]] = [(0, 0.0, 0)] + [(n + 1, 0.0, 0)] * n
        for i in range(n):
            out, many, _ = best[i]
            if (step := (out + 1, many + 1, i)) < best[i + 1]:
                best[i + 1] = step
            for j in range(i + 1, min(n, i + max(longest, GRAM)) + 1):
                mine = run[i:j] in given
                if mine or learned is not None and j - i <= GRAM and learned[j - i, i]:
                    step = (out, many + (0.9 if mine else 1.0), i)
                    if step < best[j]:
                        best[j] = step
        parts, at = [], n
        while at:
            parts.append(run[best[at][2] : at])
            at = best[at][2]
        return tuple(parts[::-1])
