"""Passages of held-out texts inside a corpus.

Windows of words, on the held-out side at every word and on the corpus side at every ``STRIDE``-th,
are embedded by a random walk that turns edit distance into Hamming distance (CGK): at each step the
walk writes the word it stands on and moves on, or not, by a random bit of step and word. Repeated
samples of the embedding's places are keys of as many hash tables; a window whose key stands in the
table of the held-out side is a candidate. Candidates are verified exactly: by the longest run of equal
words on their diagonal.

Equal windows have equal embeddings, so a run of ``RUN`` equal words is always found: it holds one
corpus window entirely.

Edited passages are not left to the chance of the tables. A stretch of a held-out text with few edits
holds some equal words in a row (``least_seed``), so short runs, taken at every word on both sides, find
all of them, and edit distances grown from the run to both sides decide: the recall is 1 by construction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .text import letter_words, mix, ragged, within

#: Fixed by the problem: a leak is a run of so many words.
RUN = 12
WINDOW, STRIDE = 8, 5
STEPS, TABLES, SAMPLE = 24, 4, 7
#: Words around a candidate that are compared; edits are allowed as a share of so many words.
BEFORE, SPAN = 4, 16
#: Words of held-out texts that are searched for in one pass over the corpus: 8 bytes each.
BLOCK = 1_000_000
WORDS_AT_ONCE = 400_000
#: Runs that are grown at a time.
GROWN_AT_ONCE = 50_000
#: Words of a held-out text that an edited stretch has: a longer one holds one of this size with no greater share of edits.
STRETCH = 2 * RUN - 1

assert RUN >= WINDOW + STRIDE - 1 and BEFORE >= STRIDE - 1 and SPAN >= BEFORE + RUN


def _samples() -> list[np.ndarray]:
    r = np.random.default_rng(12)
    # the walk stands on the last word or beyond it in the last steps, so early ones tell more
    return [np.sort(r.permutation(STEPS * 2 // 3)[:SAMPLE]) for _ in range(TABLES)]


def embed(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of the windows at ``starts``, one row per table."""
    samples = _samples()
    seeds = mix(np.arange(1, STEPS + 1, dtype=np.uint64))
    last = max(int(s.max()) for s in samples)
    keys = np.zeros((TABLES, len(starts)), dtype=np.uint64)
    at = np.zeros(len(starts), dtype=np.int64)
    padded = np.append(words, np.uint64(0))
    for j in range(last + 1):
        word = np.where(at < WINDOW, padded[np.minimum(starts + at, len(words))], np.uint64(0))
        h = mix(word ^ seeds[j])
        for t, s in enumerate(samples):
            if j in s:
                keys[t] = mix(keys[t] * np.uint64(3) + h)
        at += (h >> np.uint64(17) & np.uint64(1)).astype(np.int64)
    return keys


class Index:
    """Hash tables over all windows of the held-out texts, as sorted arrays."""

    def __init__(self, texts: list[tuple[str, list[int]]]) -> None:
        self.names = [n for n, _ in texts]
        sizes = np.array([len(w) for _, w in texts], dtype=np.int64)
        self.words = np.array([x for _, w in texts for x in w], dtype=np.int64).view(np.uint64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = np.maximum(sizes - WINDOW + 1, 0)
        self.of = np.repeat(np.arange(len(texts)), n)
        self.at = np.repeat(self.begins, n) + within(n)
        keys = embed(self.words, self.at)
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.keys = [k[o] for k, o in zip(keys, self.order)]

    def search(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the candidates: row, held-out text, longest equal run."""
        n = np.maximum((ends - begins - WINDOW) // STRIDE + 1, 0)
        row = np.repeat(np.arange(len(begins)), n)
        at = np.repeat(begins, n) + within(n) * STRIDE
        found = []
        if len(at) and len(self.at):
            for key, sorted_, order in zip(embed(words, at), self.keys, self.order):
                lo, hi = np.searchsorted(sorted_, key, "left"), np.searchsorted(sorted_, key, "right")
                hits = np.flatnonzero(hi > lo)
                many = (hi - lo)[hits]
                found.append(np.repeat(hits, many) * len(self.at) + order[np.repeat(lo[hits], many) + within(many)])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        w, q = pairs // max(1, len(self.at)), pairs % max(1, len(self.at))
        row, at, of = row[w], at[w], self.of[q]
        step = np.arange(SPAN) - BEFORE
        here = at[:, None] + step
        there = self.at[q][:, None] + step
        in_here = (here >= begins[row][:, None]) & (here < ends[row][:, None])
        in_there = (there >= self.begins[of][:, None]) & (there < self.ends[of][:, None])
        a = words[np.clip(here, 0, max(0, len(words) - 1))]
        b = self.words[np.clip(there, 0, max(0, len(self.words) - 1))]
        equal = in_here & in_there & (a == b)
        run = best = np.zeros(len(row), dtype=np.int64)
        for j in range(SPAN):
            run = np.where(equal[:, j], run + 1, 0)
            best = np.maximum(best, run)
        return row, of, best


class Edited:
    """Stretches of held-out texts of at least ``RUN`` words, with at most ``most`` edits per ``SPAN`` words."""

    def __init__(self, index: Index, most: int) -> None:
        self.index, self.most, self.seed = index, most, least_seed(most)
        sizes = index.ends - index.begins
        n = np.where(sizes >= RUN, np.maximum(sizes - self.seed + 1, 0), 0)
        of = np.repeat(np.arange(len(sizes)), n)
        at = np.repeat(index.begins, n) + within(n)
        keys = _runs(index.words, at, self.seed)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.of = keys[order], at[order], of[order]

    def search(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """Row, held-out text and edits of the stretches, some at a time."""
        n = np.maximum(ends - begins - self.seed + 1, 0)
        row = np.repeat(np.arange(len(begins)), n)
        at = np.repeat(begins, n) + within(n)
        if not len(at) or not len(self.at):
            return
        key = _runs(words, at, self.seed)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        hits = np.flatnonzero(hi > lo)
        lo, ends_of = lo[hits], np.cumsum((hi - lo)[hits])
        for first in range(0, int(ends_of[-1]) if len(hits) else 0, GROWN_AT_ONCE):
            nth = np.arange(first, min(first + GROWN_AT_ONCE, int(ends_of[-1])))
            h = np.searchsorted(ends_of, nth, "right")
            q = hi[hits[h]] - (ends_of[h] - nth)
            r, i, j, of = row[hits[h]], at[hits[h]], self.at[q], self.of[q]
            # a run that goes on to the left is left to its begin: a stretch moved there has no more edits
            same = (i == begins[r]) | (j == self.index.begins[of]) | (words[i - 1] != self.index.words[j - 1])
            for k in range(self.seed):
                same &= words[i + k] == self.index.words[j + k]
            r, i, j, of = r[same], i[same], j[same], of[same]
            edits = self._grown(words, i, begins[r], ends[r], j, self.index.begins[of], self.index.ends[of])
            good = edits < FAR
            yield r[good], of[good], edits[good]

    def _grown(self, words, i, i0, i1, j, j0, j1) -> np.ndarray:
        """Fewest edits of a stretch that holds the run at i of the row and j of the held-out text; ``FAR``
        if it has none with few enough edits."""
        reach = STRETCH - self.seed
        right = self._side(words, i + self.seed, i1 - i - self.seed, j + self.seed, j1 - j - self.seed, 1, reach)
        left = self._side(words, i - 1, i - i0, j - 1, j - j0, -1, reach)
        best = np.full(len(i), FAR, dtype=np.int8)
        for a in range(reach + 1):
            for b in range(max(0, RUN - self.seed - a), reach - a + 1):
                edits = left[a] + right[b]
                allowed = self.most * (a + self.seed + b) // SPAN
                np.minimum(best, np.where(edits <= allowed, edits, FAR), out=best)
        return best

    def _side(self, words, i, here, j, there, way: int, reach: int) -> list[np.ndarray]:
        """Edits of the next 0, 1, ... words of the held-out text against any number of words of the row."""
        band = self.most * STRETCH // SPAN
        other = self.index.words
        start = np.maximum(np.arange(-band, band + 1), 0).astype(np.int8)
        start[:band] = FAR
        cost = [np.full(len(i), x, dtype=np.int8) for x in start]
        column = {}

        def word(c: int):
            if c not in column:
                column[c] = words[np.clip(i + way * c, 0, len(words) - 1)], (here > c) & (c >= 0)
            return column[c]

        out = [np.zeros(len(i), dtype=np.int8)]
        for b in range(reach):
            mine = other[np.clip(j + way * b, 0, len(other) - 1)]
            new = []
            for k in range(2 * band + 1):
                theirs, held = word(b + k - band)
                least = cost[k] + ~(held & (theirs == mine))
                if k < 2 * band:
                    least = np.minimum(least, cost[k + 1] + np.int8(1))
                if k:
                    least = np.minimum(least, new[-1] + np.int8(1))
                new.append(np.minimum(least, FAR).astype(np.int8))
            column.pop(b - band, None)
            cost = new
            fewest = cost[0]
            for x in cost[1:]:
                fewest = np.minimum(fewest, x)
            out.append(np.where(there > b, fewest, FAR).astype(np.int8))
        return out


#: More edits than any stretch may have.
FAR = np.int8(60)


def least_seed(most: int) -> int:
    """Equal words in a row that every stretch of ``RUN`` to ``STRETCH`` words has at the most edits."""
    edits = {n: most * n // SPAN for n in range(RUN, STRETCH + 1)}
    return max(1, min(-(-(n - e) // (e + 1)) for n, e in edits.items()))


def _runs(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    key = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        key = mix(key * np.uint64(3) + words[at + k])
    return key


def leaked(corpus: DataFrame, held_out: DataFrame, key: str, name: str, most_edits: int = -1) -> DataFrame:
    """Corpus rows that hold parts of held-out texts.

    ``corpus`` has ``key`` and ``text``; ``held_out`` has ``name`` and ``passage``. Result: ``key``,
    ``name``, ``run`` (longest run of equal words seen by the tables, at most ``SPAN``) and ``edits`` (fewest
    in a stretch of at least ``RUN`` words; ``SPAN`` if none was seen), one row per pair with a run of ``RUN``
    or a stretch of ``RUN`` words or more with at most ``most_edits`` edits per ``SPAN`` words of it. Words
    outside the stretch do not count. If that is negative, only runs count, and no edits are counted.

    Defined cases: null, empty and short texts on either side match nothing; a passage that several
    names share is reported under each; repeated rows count once. The held-out side is the query
    set: it is read in blocks of about ``BLOCK`` words, dealt by hash, each a pass over the corpus whose
    result is written before the next, so that what the driver and the workers hold is bounded (a
    single text of more words is a block of its own).
    """
    asked = held_out.where(F.col("passage").isNotNull() & F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"), letter_words(F.col("passage")).alias("words")).distinct()
    asked = asked.where(F.size("words") >= WINDOW)
    total = asked.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    if blocks > 1:
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks))))
    kind = corpus.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{name}` string, run int, edits int"
    words = corpus.where(F.col("text").isNotNull()).select(key, letter_words(F.col("text")).alias("words"))
    passes = []
    for i in range(blocks):
        here = asked.where(F.col("block") == i) if blocks > 1 else asked
        block = sorted((r["name"], list(r["words"])) for r in here.collect())

        def run(batches, block=block):
            index = Index(block)
            edited = Edited(index, most_edits) if most_edits >= 0 else None
            names = pa.array(index.names, pa.string())
            for b in batches:
                flat, borders = ragged(b.column(1))
                flat = flat.view(np.uint64)
                start = 0
                while start < b.num_rows:
                    stop = max(start + 1, int(np.searchsorted(borders, borders[start] + WORDS_AT_ONCE, "right")) - 1)
                    stop = min(stop, b.num_rows)
                    base = borders[start]
                    part = flat[base : borders[stop]], borders[start:stop] - base, borders[start + 1 : stop + 1] - base
                    row, of, best = index.search(*part)
                    near = list(edited.search(*part)) if edited else []
                    close = np.concatenate([np.empty(0, dtype=np.int64), *(r * len(block) + o for r, o, _ in near)])
                    seen = row * len(block) + of
                    seen_good = (best >= RUN) | np.isin(seen, close)
                    seen, best = seen[seen_good], best[seen_good]
                    pair = np.unique(np.concatenate([seen, close]))
                    longest, fewest = np.zeros(len(pair), dtype=np.int32), np.full(len(pair), SPAN, dtype=np.int32)
                    np.maximum.at(longest, np.searchsorted(pair, seen), best.astype(np.int32))
                    if near:
                        np.minimum.at(fewest, np.searchsorted(pair, close), np.concatenate([e for *_, e in near]).astype(np.int32))
                    if len(pair):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(start + pair // len(block))), names.take(pa.array(pair % len(block))), pa.array(longest), pa.array(fewest)], names=[key, name, "run", "edits"])
                    start = stop

        found = words.mapInArrow(run, schema)
        passes.append(cut(found) if blocks > 1 else found)
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def _leaks(spark: SparkSession, d: str, most_edits: int) -> DataFrame:
    return leaked(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "questions"), "doc_id", "question_id", most_edits)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, -1).where(F.col("run") >= RUN).select("doc_id", "question_id").distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Per question: documents that hold it, wholly or partly, or with small edits."""
    return _leaks(spark, d, 4).groupBy("question_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("run") >= RUN, F.col("doc_id"))).alias("verbatim"), F.min("edits").alias("fewest_edits"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
SQL = {
    "p9_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT question_id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM questions WHERE passage IS NOT NULL),
ds AS (SELECT doc_id, list_aggregate(list_slice(w, i, i + 11), 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
qs AS (SELECT question_id, list_aggregate(list_slice(w, i, i + 11), 'string_agg', ' ') AS s FROM (SELECT question_id, w, unnest(range(1, len(w) - 10)) AS i FROM q WHERE len(w) >= 12))
SELECT DISTINCT doc_id, question_id FROM ds JOIN qs USING (s)""",
}
