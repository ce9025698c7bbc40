"""The language of texts, and of the parts of texts in several languages.

A bit-sliced Bloom filter maps the n-grams of letters to sets of languages: a slot is a mask with one
bit per language, an n-gram owns two slots, and the AND of both is the set of languages that contain
it. A piece of text counts, per language, the n-grams whose mask has its bit (popcounts), corrected for
the share that hits by chance at the language's fill; the corrected shares decide and give the
confidence.

The filter is trained here, on a bounded sample: at most ``TRAIN_ROWS`` pieces of ``PIECE_CHARS``
characters per declared language, drawn from all parts of all declared texts. Declarations may be wrong: an n-gram belongs to a language only if it is not much rarer there
than elsewhere, and a second round drops rows that the first contradicts. Texts are read as intended:
wrong decodings are undone and look-alikes folded before.

A text with too few n-grams to decide by them is read by all it has: its letters, its n-grams, what it is
declared as, and how many rows the languages have (``brief``).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .chars import triple_counts
from .garbled import Judge, evidence, repaired
from .lookalike import SLOTS as PAIR_SLOTS
from .lookalike import Former
from .text import batch, blank, mix

TRAIN_ROWS, PIECE_CHARS = 1500, 2000
#: Languages that a mask has bits for.
MOST_LANGUAGES = 64
SLOTS = 1 << 20
#: The codes and English names of languages (ISO 639).
_NAMES = """
en eng english|fr fra fre french|de deu ger german|es spa spanish castilian|it ita italian|pt por portuguese|nl nld dut dutch|ru rus russian|ar ara arabic|ur urd urdu|hi hin hindi|zh zho chi chinese mandarin cmn|ja jpn japanese|th tha thai
"""
CODES = {n: names.split()[0] for names in _NAMES.strip().split("|") for n in names.split()}
#: A gain from which a text is read by the chain that explains it.
CHAIN_GAIN = 9.0
#: Letters of a piece that make a sentence of another language.
SENTENCE_LETTERS, WIDE_LETTERS = 16, 7
#: The same for a piece of three words or more with an end mark, if the next language is so much behind.
ENDED_LETTERS, ENDED_WIDE, ENDED_MARGIN = 7, 4, 0.3
LEAST_SHARE, LEAST_MARGIN = 0.3, 0.06
#: N-grams of a text of one piece from which they alone decide.
LEAST_GRAMS, LEAST_WIDE = 6, 4
#: How much likelier than another a language is for being declared, where little else tells.
DECLARED = 8.0


def code(c: Column) -> Column:
    """ISO 639-1 of a declared language in any spelling; null if it names none that is known."""
    first = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    table_ = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.try_element_at(table_, first)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of letter n-grams (two and four characters, borders of words included) at each
    position, and which are n-grams of a word."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c <= 0x2FFF)) & ~((c >= 0x3000) & (c <= 0x3004)) & ~((c >= 0x3008) & (c <= 0x3020)) & (c != 0x30FB) & ~((c >= 0xFF00) & (c <= 0xFF0F)) & ~((c >= 0xFF1A) & (c <= 0xFF20)) & (c < 0xFFF0) & (c != 0x964) & (c != 0x6D4) & (c != 0x60C) & (c != 0x61F))
    c = np.where(letter, c, 0).astype(np.uint64)
    p = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(3, np.uint64)])
    k = np.concatenate([[False], letter, [False] * 3])
    n = len(c)
    two = mix(p[1 : n + 1] * np.uint64(0x9E3779B97F4A7C15) + p[2 : n + 2])
    four = mix(mix(p[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + p[1 : n + 1]) ^ mix(p[2 : n + 2] * np.uint64(0x165667B19E3779F9) + p[3 : n + 3] + np.uint64(7)))
    wide = c >= 0x0E00
    ok2 = k[1 : n + 1] & k[2 : n + 2] & wide
    ok4 = k[1 : n + 1] & k[2 : n + 2] & ~wide
    return np.where(ok2, two, four), ok2 | ok4


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)


class Filters:
    """The trained filter: ``masks`` by slot, the languages by bit, and chance hits by language."""

    def __init__(self, texts: list[str], labels: list[str], rows: dict[str, int] | None = None) -> None:
        self.langs = sorted(set(labels))
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"a mask has bits for {MOST_LANGUAGES} languages")
        number = {x: i for i, x in enumerate(self.langs)}
        y = np.array([number[x] for x in labels], dtype=np.int64)
        texts = [t.lower() + "\n" for t in texts]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        h, ok = grams("".join(texts))
        who = np.repeat(np.arange(len(texts)), lengths)
        h, who = h[ok], who[ok]
        keep = np.ones(len(texts), dtype=bool)
        for _ in range(2):
            use = keep[who]
            self._fit(h[use], y[who[use]])
            shares = self._shares(self._look(h), who, len(texts))
            keep = shares.argmax(1) == y if len(texts) else keep
        rows = rows or {}
        self.prior = np.log(np.array([rows.get(x, 1) for x in self.langs], dtype=float) + 1.0)
        # how often each language uses each letter; letters alone tell scripts apart
        seen: dict[str, np.ndarray] = {}
        for text, i, good in zip(texts, y, keep):
            if good:
                for ch, n in Counter(text).items():
                    if ch.isalpha():
                        seen.setdefault(ch, np.zeros(len(self.langs)))[i] += n
        total = np.maximum(sum(seen.values()), 1.0) if seen else 1.0
        self.letters = {ch: np.log(v / total + 1e-6) for ch, v in seen.items()}

    def brief(self, pieces: list[str], shares: np.ndarray, sizes: np.ndarray, declared: str | None) -> dict[str, tuple[int, float]]:
        """The language of a text too short for its n-grams to decide, with the confidence that all it
        has allows; none if it has no letter."""
        letters = sorted({ch for p in pieces for ch in p.lower() if ch.isalpha()})
        if not letters or not self.langs:
            return {}
        sure = self.prior + sum(self.letters.get(ch, 0.0) for ch in letters)
        sure = sure + (sizes[:, None] * np.log(shares + 0.05)).sum(0)
        if declared in self.langs:
            sure[self.langs.index(declared)] += np.log(DECLARED)
        sure = np.exp(sure - sure.max())
        best = int(sure.argmax())
        return {self.langs[best]: (max(1, int(sizes.sum())), float(sure[best] / sure.sum()))}

    def _fit(self, h: np.ndarray, y: np.ndarray) -> None:
        n = len(self.langs)
        total = np.maximum(np.bincount(y, minlength=n), 1)
        order = np.argsort(h, kind="stable")
        h, y = h[order], y[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        gram = np.cumsum(new) - 1
        keys = h[new]
        count = np.bincount(gram * n + y, minlength=len(keys) * n).reshape(-1, n) if len(h) else np.zeros((0, n))
        rate = count / total
        member = (rate >= 0.2 * rate.max(1, keepdims=True)) & (count >= 2) if len(h) else np.zeros((0, n), bool)
        mask = np.bitwise_or.reduce(np.where(member, np.uint64(1) << np.arange(n, dtype=np.uint64), np.uint64(0)), axis=1) if n else np.zeros(len(keys), dtype=np.uint64)
        self.masks = np.zeros(SLOTS, dtype=np.uint64)
        for slot in _slots(keys):
            np.bitwise_or.at(self.masks, slot, mask)
        fill = np.array([((self.masks >> np.uint64(i)) & np.uint64(1)).mean() for i in range(n)])
        self.chance = fill**2

    def _look(self, h: np.ndarray) -> np.ndarray:
        a, b = _slots(h)
        return self.masks[a] & self.masks[b]

    def _shares(self, masks: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
        many = np.maximum(np.bincount(who, minlength=n), 1)
        # bits of a mask that has nearly all tell nothing
        hits = np.stack([np.bincount(who, weights=(masks >> np.uint64(i)) & np.uint64(1), minlength=n) for i in range(len(self.langs))], 1) if self.langs else np.zeros((n, 1))
        share = hits / many[:, None]
        return np.maximum((share - self.chance) / (1 - self.chance), 0.0) if self.langs else share

    def score(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language in each piece, and the pieces' n-grams."""
        pieces = [p.lower() + "\n" for p in pieces]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        h, ok = grams("".join(pieces))
        who = np.repeat(np.arange(len(pieces)), lengths)[ok]
        return self._shares(self._look(h[ok]), who, len(pieces)), np.bincount(who, minlength=len(pieces))


_PIECE = re.compile(r"[^.!?…。！？؟۔।\n]*(?:[.!?…](?=[^\s\"'»”’)\]A-ZÀ-ÞЀ-Я؀-ۿऀ-ॿ฀-๿぀-鿿«“„¿¡])[^.!?…。！？؟۔।\n]*)*[.!?…。！？؟۔।\n]*[\"'»”’)\]]*")
_CODE = re.compile(r"[A-Za-z0-9\\_@./:()\[\]-]*[0-9\\_@][A-Za-z0-9\\_@./:()\[\]-]*")
_NAMED = re.compile(r"\b[A-ZÀ-Þ][a-zà-ÿ]+\b")
_FOREIGN = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ ,;.'’\d/()\[\]-]{24,}")
_NOT_LATIN = re.compile(r"[Ѐ-ӿ؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿]")

_ENDED = re.compile(r"[.!?…。！？؟۔।][\"'»”’)\]]*\s*$")
_WIDE = re.compile(r"[฀-๿぀-ヿ一-鿿]")


def pieces_of(text: str) -> list[str]:
    """Sentence-like pieces, without codes; runs of Latin words inside other scripts apart."""
    out = []
    for m in _PIECE.findall(text):
        p = _CODE.sub(" ", m) if any(ch.isdigit() for ch in m) else m
        if not p.strip():
            continue
        if _NOT_LATIN.search(p):
            runs = [r for r in _FOREIGN.findall(p) if sum(w.islower() for w in r.split()) >= 3]
            for r in runs:
                p = p.replace(r, " ")
                out.append(r)
            p = _NAMED.sub(" ", p)
        out.append(p)
    return out


def ended(piece: str) -> bool:
    """Whether a piece looks like a whole sentence: an end mark, and words that are no row of names."""
    words = piece.split()
    first = [w.lstrip("\"'«“„‘([¿¡")[:1] for w in words]
    small = sum(c.isalpha() and not c.isupper() for c in first)
    return bool(_ENDED.search(piece)) and (bool(_WIDE.search(piece)) or len(words) >= 3 and small >= 2)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from at most ``TRAIN_ROWS`` pieces of declared texts per language, taken by hash.

    A text of any length is cut into pieces of ``PIECE_CHARS``, each as likely to be taken as another.
    What reaches the driver is bounded by these numbers and the languages known.
    """
    whole = df.where(~blank(F.col(text)) & (F.length(text) >= 40)).select(F.col(text).alias("whole"), code(F.col(lang)).alias("lang")).where("lang is not null")
    starts = F.when(F.length("whole") <= PIECE_CHARS, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("whole"), F.lit(PIECE_CHARS)))
    rows = whole.withColumn("start", F.explode(starts)).select(F.substring(F.col("whole"), F.col("start"), F.lit(PIECE_CHARS)).alias("text"), "lang")
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return Filters([], [])
    part = F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, min(1.0, TRAIN_ROWS / n))])
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    taken = rows.where(share < F.element_at(part, F.col("lang"))).limit(2 * TRAIN_ROWS * len(CODES)).toPandas().sort_values(["lang", "text"])
    return Filters(taken["text"].tolist(), taken["lang"].tolist(), many)


def decide(shares: np.ndarray, sizes: np.ndarray, langs: list[str], pieces: list[str] | None = None) -> dict[str, tuple[int, float]]:
    """Languages of the pieces of one text: n-grams and confidence of each; none where the n-grams are too few."""
    order = np.sort(shares, 1)
    top = shares.argmax(1)
    margin = order[:, -1] - (order[:, -2] if shares.shape[1] > 1 else 0.0)
    sure = (order[:, -1] >= LEAST_SHARE) & (margin >= LEAST_MARGIN) & (sizes > 3)
    whole = (shares * sizes[:, None]).sum(0)
    if not sizes.sum() or whole.max() <= 0:
        return {}
    # the main language has most of the text in pieces of its own
    own = np.bincount(top, weights=np.where(sure, sizes, 0), minlength=len(langs))
    main = int(own.argmax()) if own.any() else int(whole.argmax())
    wide = langs[main] in ("zh", "ja", "th")
    lang = np.where(sure & (shares[np.arange(len(top)), main] < order[:, -1] - 0.15), top, main)
    out: dict[str, tuple[int, float]] = {}
    for i in np.unique(lang):
        mine = lang == i
        broad = langs[i] in ("zh", "ja", "th")
        if i != main and sizes[mine].max() < (WIDE_LETTERS if broad else SENTENCE_LETTERS):
            short = mine & (sizes >= (ENDED_WIDE if broad else ENDED_LETTERS)) & (margin >= ENDED_MARGIN)
            if not any(ended(pieces[k]) for k in np.flatnonzero(short)) if pieces else True:
                continue
        mean = (shares[mine] * sizes[mine][:, None]).sum(0) / max(1, sizes[mine].sum())
        if mean[i] <= 0 or (i == main and sizes[mine].max() < (LEAST_WIDE if wide else LEAST_GRAMS) and len(lang) == 1):
            continue
        cube = mean**3
        out[langs[i]] = (int(sizes[mine].sum()), float(cube[i] / cube.sum()))
    return out


def identify(df: DataFrame, key: str, text: str = "text", lang: str = "lang", short: bool = True) -> DataFrame:
    """One row per text and language in it: ``key``, ``declared`` (as a code), ``lang``, ``share`` of
    the text, ``confidence``, ``languages`` (how many) and ``chars`` (length as stored).

    Defined cases: null and blank texts, and texts without letters outside of codes, have no row; texts of
    too few n-grams have one of lower confidence, by letters, declaration and pool, or none if not ``short``;
    a row repeated in full counts once; unknown declarations are null; with nothing declared
    anywhere there is nothing to learn from and no row. Texts of any length are read whole.
    """
    rows = df.where(F.col(key).isNotNull() & ~blank(F.col(text))).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), code(F.col(lang)).alias("declared"))
    sc = df.sparkSession.sparkContext
    model, counts = sc.broadcast(train(df, text, lang)), sc.broadcast(triple_counts(rows))

    def run(batches):
        filters, judge, former = model.value, Judge(counts.value), Former(np.zeros(PAIR_SLOTS))
        langs = filters.langs
        for b in batches:
            got = {k: [] for k in ("key", "declared", "lang", "share", "confidence", "languages", "chars")}
            keys, texts, declared = (b.column(i).to_pylist() for i in range(3))
            start = 0
            while langs and start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                group = texts[start:stop]
                for i, total in enumerate(evidence(group, judge)):
                    if total and max(total.values()) >= CHAIN_GAIN:
                        group[i] = repaired(group[i], max(total, key=total.get), judge)
                cut = [pieces_of(former.form(t)) for t in group]
                shares, sizes = filters.score([p for c in cut for p in c])
                at = 0
                for i, c in enumerate(cut):
                    found = decide(shares[at : at + len(c)], sizes[at : at + len(c)], langs, c) if c else {}
                    if short and not found and c:
                        found = filters.brief(c, shares[at : at + len(c)], sizes[at : at + len(c)], declared[start + i])
                    at += len(c)
                    whole = sum(n for n, _ in found.values())
                    for name, (n, sure) in found.items():
                        for k, v in zip(got, (keys[start + i], declared[start + i], name, n / whole, sure, len(found), len(texts[start + i]))):
                            got[k].append(v)
                start = stop
            yield batch(got, share=pa.float64(), confidence=pa.float64(), languages=pa.int32(), chars=pa.int32())

    return rows.mapInArrow(run, "key string, declared string, lang string, share double, confidence double, languages int, chars int").withColumnRenamed("key", key)


def p5_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each segment and each part in another language, with a confidence."""
    out = identify(table(spark, d, "segments"), "segment_id")
    return out.select("segment_id", "lang", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"), "languages").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").where(F.length("text") >= 40)
    out = identify(rows, "segment_id", short=False)
    return out.where((F.col("languages") > 1) | ~F.col("lang").eqNullSafe(F.col("declared"))).select("segment_id", "lang").distinct()


QUERIES = {"p5_found": p5_found, "p5_parts": p5_parts}
SQL: dict[str, str] = {}
