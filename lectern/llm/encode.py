"""Encoding a corpus with a public byte-level BPE vocabulary, by speculation and verification.

Every word (a match of the vocabulary's split pattern) is first cut greedily into the longest known
tokens. A sequence of tokens is the one that merging gives if and only if each adjacent pair is what
merging gives for the bytes of the two, so the adjacent pairs of all words of a batch are tested
together, as arrays, by undoing merges on both sides of the border. Words with a failing pair, and
only these, are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: The split pattern published with the vocabulary: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
#: Distinct words and pieces that a worker keeps between batches; beyond it the memory starts anew.
WORDS_KEPT = 200_000
PIECES_KEPT = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the
    others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Bpe:
    """A byte-level BPE whose ids above the single bytes are in the order of the merges."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        raw = {w: bytes(letters[c] for c in w) for w in model["vocab"] if all(c in letters for c in w)}
        self.vocab = {raw[w]: i for w, i in model["vocab"].items() if w in raw}
        n = max(self.vocab.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys, values = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.vocab[raw[a]], self.vocab[raw[b]], self.vocab[raw[a] + raw[b]]
            self.left[z], self.right[z] = x, y
            keys.append(x << 32 | y)
            values.append(z)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]
        self.merge = dict(zip(keys, values))
        self.longest: dict[bytes, int] = {}
        for w in self.vocab:
            self.longest[w[:2]] = max(len(w), self.longest.get(w[:2], 1))
        self.split = regex.compile(PATTERN).findall
        self.unsafe = regex.compile(r" \s|\x00").search
        self.forget()
        self.known: dict[str, tuple[int, ...]] = {}
        self.failed = 0

    def greedy(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        get, longest = self.vocab.get, self.longest.get
        while at < n:
            end = min(n, at + longest(word[at : at + 2], 1))
            while (t := get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging in the order of the merges, with a heap: n log n for a word of n bytes."""
        ids = [self.vocab[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merge.get
        heap = [(z, i, ids[i], ids[i + 1]) for i in range(n - 1) if (z := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            z, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := get(z << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i, z, ids[k]))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 32 | z)) is not None:
                heapq.heappush(heap, (m, h, ids[h], z))
        return [t for t in ids if t >= 0]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (x << 32 | y): does merging the bytes of both give x, y again?

        Undoes the later of the two merges that lie at the border, step by step; a merge across the
        border that comes before the one undone last would have been taken instead.
        """
        ok = np.ones(len(pairs), dtype=bool)
        live = np.arange(len(pairs))
        x, y = pairs >> 32, pairs & 0xFFFFFFFF
        bound = np.full(len(pairs), 1 << 40, dtype=np.int64)
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.values[at], 1 << 41)
            lost = across < bound
            ok[live[lost]] = False
            x_base, y_base = self.left[x] == x, self.left[y] == y
            done = lost | (x_base & y_base)
            undo_x = ~x_base & ((x > y) | y_base)
            bound = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            go = ~done
            live, x, y, bound = live[go], x[go], y[go], bound[go]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words that were not met before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self.greedy(w) for w in raw]
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), dtype=np.int64, count=int(lengths.sum()))
        if len(flat) > 1:
            inner = np.ones(len(flat), dtype=bool)
            inner[np.cumsum(lengths)[:-1]] = False
            at = np.flatnonzero(inner[1:])
            pairs, where = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
            bad = ~self.compatible(pairs)[where]
            owner = np.repeat(np.arange(len(tokens)), lengths)
            for i in np.unique(owner[at[bad]]):
                tokens[i] = self.exact(raw[i])
                self.failed += 1
        self.known.update(zip(words, tokens))

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.store: list[int] = []
        self.starts: list[int] = [0]

    def pieces(self, text: str | None) -> list[str]:
        """The text in pieces whose borders are borders of words too.

        A space that is followed by something else than a blank always begins a word. Texts with
        blanks after a space are cut by the pattern itself.
        """
        if not text:
            return []
        if self.unsafe(text) or text[-1] == " ":
            return self.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def keep(self, pieces: list[str]) -> None:
        """Encode pieces that were not met before and add them to the store."""
        cut = [self.split(p) for p in pieces]
        met = set().union(*cut)
        new = met.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = met
        self.learn(list(new))
        known, store, starts, index = self.known, self.store, self.starts, self.index
        for p, words in zip(pieces, cut):
            for w in words:
                store.extend(known[w])
            index[p] = len(starts) - 1
            starts.append(len(store))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        cut = [self.pieces(t) for t in texts]
        flat = [p for c in cut for p in c]
        if len(self.index) > PIECES_KEPT:
            self.forget()
        get = self.index.get
        at = np.fromiter(map(get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        unmet = np.flatnonzero(at < 0)
        if len(unmet):
            self.keep(list(dict.fromkeys(flat[i] for i in unmet)))
            at[unmet] = [self.index[flat[i]] for i in unmet]
        starts, store = np.array(self.starts, dtype=np.int64), np.array(self.store, dtype=np.int32)
        sizes = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], sizes)
        borders = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        return store[take], ends[borders].astype(np.int32)


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_texts(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` for each row of ``df``.

    A null or empty text has the empty list; blanks are text and have ids. Repeated rows stay
    repeated. Text of any length is encoded whole: a word of n bytes costs n log n at most.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.json"
    # the driver's copy is sent to the executors, which need no folder of their own
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches):
        bpe = load(SparkFiles.get(name))
        for b in batches:
            texts = b.column(1)
            # texts are joined in groups of bounded length, so that memory does not follow the batch
            start, n = 0, b.num_rows
            while start < n:
                stop, size, group = start, 0, []
                while stop < n and (not group or size < 2_000_000):
                    t = texts[stop].as_py()
                    group.append(t)
                    size += len(t or "")
                    stop += 1
                ids, ends = bpe.encode(group)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[key, "ids"])
                start = stop

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
