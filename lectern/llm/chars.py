"""Counts of character triples over a whole corpus, as a scorer of spellings.

Beside the triples, each character beyond ASCII is counted between the classes of its two neighbours
(blank, small or capital Latin letter, digit, sign, another script): these counts are fewer and so surer.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import dense_counts, mix

#: Counters of each of two tables; a triple counts as often as the lesser of its two says.
SLOTS = 1 << 20
#: Counters of characters between classes, behind the triples' two tables.
SETTINGS = 1 << 19
#: What makes up less than this share of all characters beyond ASCII says little: wrong texts repeat too.
FAINT = 1e-5
CHARS_AT_ONCE = 2_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def points(text: str) -> np.ndarray:
    """Code points, with every ASCII digit as 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((c >= 48) & (c <= 57), np.uint32(48), c)


@cache
def _small() -> np.ndarray:
    """The small letter of each code point up to U+0590."""
    return np.array([ord(x) if len(x := chr(o).lower()) == 1 else o for o in range(0x590)], dtype=np.uint32)


def triples(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all triples of neighbours in both tables, whatever their case, and which hold a
    character beyond ASCII."""
    if len(c) < 3:
        return np.empty((2, 0), dtype=np.int64), np.empty(0, dtype=bool)
    u = np.where(c < 0x590, _small()[np.minimum(c, 0x58F)], c).astype(np.uint64)
    h = mix(u[:-2] * _A + u[1:-1] * _B + u[2:] * _C)
    beyond = c > 127
    first, second = (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)
    return np.stack([first, second + SLOTS]), beyond[:-2] | beyond[1:-1] | beyond[2:]


#: First code points of scripts, each up to the next, from where letters aren't looked at one by one.
_BLOCKS = (0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x1E00, 0x1F00, 0x2000)


@cache
def _classes() -> np.ndarray:
    """The class of each code point up to U+2FFF; the rest is East Asian."""
    out = np.zeros(0x3000, dtype=np.uint8)
    for o in range(0x3000):
        kind = unicodedata.category(chr(o))
        if o < 0x250 and kind[0] == "L":
            out[o] = 2 if kind == "Lu" else 1
        elif kind[0] == "N":
            out[o] = 3
        elif kind in ("Ps", "Pi"):
            out[o] = 4
        elif kind in ("Pe", "Pf", "Po"):
            out[o] = 5
        elif kind[0] == "Z" or o in (9, 10, 13):
            out[o] = 0
        elif kind[0] in "LM" and o >= 0x250:
            out[o] = 8 + sum(o >= b for b in _BLOCKS)
        else:
            out[o] = 6
    return out


def settings(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all characters between the classes of their neighbours, and which are beyond ASCII;
    one for each triple."""
    if len(c) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    table = _classes()
    kind = np.where(c < 0x3000, table[np.minimum(c, 0x2FFF)], np.uint8(7)).astype(np.uint64)
    h = mix(c[1:-1].astype(np.uint64) * _A + kind[:-2] * _B + kind[2:] * _C)
    return (h & np.uint64(SETTINGS - 1)).astype(np.int64) + 2 * SLOTS, c[1:-1] > 127


def slices(texts, size: int = CHARS_AT_ONCE):
    """Runs of texts of about ``size`` characters, with the index of the first."""
    start, n, group = 0, 0, []
    for i, t in enumerate(texts):
        if group and n + len(t) > size:
            yield start, group
            start, n, group = i, 0, []
        group.append(t)
        n += len(t)
    if group:
        yield start, group


WIDTH = 2 * SLOTS + SETTINGS


def slots_of(texts: list[str]):
    """The slots that count for texts."""
    # each blank stands for any, and texts begin and end with one
    c = points(" " + " ".join(texts) + " ")
    c = np.where((c == 10) | (c == 9) | (c == 13) | (c >= 0x2000) & (c <= 0x200B), np.uint32(32), c)
    c[1:][(c[1:] == 0xA0) & (c[:-1] < 128)] = 32
    slot, beyond = triples(c)
    yield slot[:, beyond].ravel()
    slot, beyond = settings(c)
    yield slot[beyond]


def triple_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each slot's triples, and characters in their settings, occur in all texts; two tables of
    ``SLOTS`` and one of ``SETTINGS`` numbers reach the driver."""

    def count(batch):
        for _, group in slices(batch.column(0).to_pylist()):
            yield from slots_of(group)

    some = df.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(text)
    return dense_counts(some, WIDTH, count).astype(np.float32)


def spelling_scores(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word the mean log count of its triples with a character beyond ASCII, how many they
    are, the mean log count of its characters beyond ASCII in their settings, and how many these are."""
    if not words:
        return (np.empty(0),) * 4
    c = points(" " + " ".join(words) + " ")
    sizes = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - 1
    faint = max(0.3, FAINT * float(counts[2 * SLOTS :].sum(dtype=np.float64)))
    out = []
    for slot, beyond in (triples(c), settings(c)):
        seen = counts[slot].min(0) if slot.ndim == 2 else counts[slot]
        # a word's triples are those whose middle is in the word
        total = np.concatenate([[0.0], np.cumsum(np.where(beyond, np.log(seen + faint), 0.0))])
        many = np.concatenate([[0], np.cumsum(beyond)])
        n = many[ends] - many[starts]
        out += [(total[ends] - total[starts]) / np.maximum(n, 1), n]
    return tuple(out)
