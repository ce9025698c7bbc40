"""Edit operations of recognised text, and normal forms, in Arrow batches."""

from __future__ import annotations

import difflib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_counts(a: list, b: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions that make ``b`` of ``a``.

    Of several shortest ways the one is counted that, from the end, prefers a match, then a
    substitution, a deletion, an insertion.
    """
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[v] for v in a], dtype=np.int64), np.array([codes[v] for v in b], dtype=np.int64)
    rows = [np.arange(len(y) + 1)]
    step = np.arange(len(y) + 1)
    for i, v in enumerate(x):
        up = rows[-1] + 1
        best = np.minimum(up[1:], rows[-1][:-1] + (y != v))
        # an insertion adds one to the value on the left: a running minimum after taking out the slope
        new = np.concatenate([[i + 1], best])
        rows.append(np.minimum.accumulate(new - step) + step)
    i, j, s, d, n = len(x), len(y), 0, 0, 0
    while i or j:
        here = rows[i][j]
        if i and j and x[i - 1] == y[j - 1] and rows[i - 1][j - 1] == here:
            i, j = i - 1, j - 1
        elif i and j and rows[i - 1][j - 1] + 1 == here:
            i, j, s = i - 1, j - 1, s + 1
        elif i and rows[i - 1][j] + 1 == here:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return s, d, n


def collapsed(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def category(text: str, first: str) -> list[str]:
    return [c for c in text if unicodedata.category(c)[0] == first]


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")])
_METRICS = T.StructType(
    [T.StructField("character_edits", _COUNTS), T.StructField("word_edits", _COUNTS)]
    + [T.StructField(n, T.IntegerType()) for n in ("line_edits", "characters", "words", "lines")]
    + [T.StructField(n, T.DoubleType()) for n in ("cer", "wer", "punctuation_accuracy", "numeral_accuracy")]
    + [T.StructField(n, T.IntegerType()) for n in ("punctuation", "numerals")]
)


def _accuracy(a: list[str], b: list[str]) -> float:
    if not a:
        return 1.0 if not b else 0.0
    return max(0.0, 1.0 - sum(edit_counts(a, b)) / len(a))


def measure(reference: str | None, hypothesis: str | None) -> tuple:
    """Metrics of one pair; a null text counts as empty."""
    ref, hyp = reference or "", hypothesis or ""
    a, b = collapsed(ref), collapsed(hyp)
    chars, words = edit_counts(list(a), list(b)), edit_counts(a.split(), b.split())
    la, lb = ([collapsed(x) for x in t.splitlines() if x.strip()] for t in (ref, hyp))
    p, n = category(a, "P"), category(a, "N")
    return (
        chars, words, sum(edit_counts(la, lb)), len(a), len(a.split()), len(la),
        round(sum(chars) / max(1, len(a)), 6), round(sum(words) / max(1, len(a.split())), 6),
        round(_accuracy(p, category(b, "P")), 6), round(_accuracy(n, category(b, "N")), 6), len(p), len(n),
    )


@F.pandas_udf(_METRICS)
def text_metrics(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    names = _METRICS.names
    rows = [measure(a, b) for a, b in zip(reference, hypothesis)]
    out = pd.DataFrame(rows, columns=names)
    for c in ("character_edits", "word_edits"):
        out[c] = [dict(zip(("substitutions", "deletions", "insertions"), x)) for x in out[c]]
    return out


@F.pandas_udf(T.StringType())
def nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, 1 for two empty texts; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


#: Ways of comparing Arabic texts, from the strictest on.
MODES = ("raw", "exact_nfc", "whitespace_normalized", "diacritic_insensitive", "verse_symbol_normalized", "arabic_letters_only")
#: Vowel signs and verse signs of Arabic.
_VOWELS, _VERSES = re.compile("[ً-ٰٟ]"), re.compile("[۝﴾﴿]")
_ARABIC = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def normal_form(text: str, mode: str) -> str:
    if mode == "raw":
        return text
    if mode == "arabic_letters_only":
        return "".join(c for c in _ARABIC.findall(unicodedata.normalize("NFKC", text)) if unicodedata.category(c)[0] == "L")
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    t = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    if mode == "exact_nfc":
        return t
    drop = {"diacritic_insensitive": _VOWELS, "verse_symbol_normalized": _VERSES}.get(mode)
    return " ".join((drop.sub("", t) if drop else t).split())


def normalized(c: Column, mode: str) -> Column:
    """A text in one of the forms; null stays null."""

    @F.pandas_udf(T.StringType())
    def form(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else normal_form(x, mode))

    return form(c)
