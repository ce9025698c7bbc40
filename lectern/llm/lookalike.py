"""One form for texts that look the same.

Compatibility forms are folded, ignorable characters deleted and blanks and hyphens made ordinary. A
word that mixes scripts, or consists of look-alikes of another script than its text, opens a lattice: each
letter may be itself or one of its look-alikes. Viterbi picks the path with the best sum of character
pair scores, taken from counts over the whole corpus, where a change of script inside a word costs
more than any pair gains.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .chars import slices
from .text import blank, dense_counts, mix

#: Letters that look alike, in rows of Latin, Cyrillic and Greek (a blank where there is none).
_ROWS = """
A А Α|B В Β|C С |E Е Ε|H Н Η|I І Ι|J Ј |K К Κ|M М Μ|N  Ν|O О Ο|P Р Ρ|S Ѕ |T Т Τ|X Х Χ|Y У Υ|Z  Ζ
a а α|c с |e е |h һ |i і ι|j ј |o о ο|p р ρ|s ѕ |x х χ|y у |v  ν|k к κ|d ԁ |q ԛ |w ԝ |u  υ|n  η|t  τ|m  |r г |Ï Ї Ϊ|ï ї ϊ|ë ё |Ë Ё |l ӏ
"""
_SCRIPTS = ("latin", "cyrillic", "greek")
#: Letters of Arabic as used for Arabic and for Urdu, of one look.
_ARABIC, _URDU = "كيىه", "کییہ"
#: Signs that stand for others of one look.
_HYPHENS = "‐‑⁃﹣－˗"
_BLANKS = "               　"
_IGNORED = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
_JOINERS = "‌‍"

LIKE: dict[str, dict[str, str]] = {}
for _line in _ROWS.strip().splitlines():
    for _cell in _line.split("|"):
        _forms = (_cell.split(" ") + ["", ""])[:3]
        for _f in _forms:
            if _f:
                LIKE[_f] = {s: x for s, x in zip(_SCRIPTS, _forms) if x and x != _f}

SLOTS = 1 << 18
#: What a change of script inside a word costs, in nats.
CHANGE = 12.0

_C = "Ѐ-ԯ"
_G = "Ͱ-Ͽ"
_L = "A-Za-zÀ-ɏ"
#: Text without any of these is in its one form already.
_MAYBE = re.compile(f"[­ ̀-ͯ؜ٓ-ٕᅟᅠ ឴឵᠋-᠎ -‏‐‑ -  -⁯⁃˗ℂ-⅏Ⅰ-ⅿ①-⓿⺀-⿟　゙゚ㄱ-ㆎ㈀-㏿豈-﫿ﬀ-﷿︀-️︰-﻿！-￯\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff\U0002f800-\U0002fa1f{_C}{_G}كيىه]|ํา|เเ")
_LETTERLIKE = re.compile("[ℂ-ℕℙ-℡℣-℺ⅅ-ⅉⅠ-ⅿ①-⓿⺀-⿟ㄱ-ㆎ豈-﫿ﬀ-ﭏﭐ-﷿ﹰ-ﻼ０-９Ａ-Ｚａ-ｚｦ-ﾟ\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff\U0002f800-\U0002fa1f]+")
_WIDE_MARK = re.compile("[！-／：-＠［-｀｛-･]")
_EAST = re.compile("[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_JOINED = re.compile("[؀-ۿऀ-෿]")
_TOKEN = re.compile(f"[{_L}{_C}{_G}]+")
_SPACE = {ord(c): " " for c in _BLANKS}
_DROP = {ord(c): None for c in _IGNORED}
_HYPHEN = {ord(c): "-" for c in _HYPHENS}


def _script(ch: str) -> str | None:
    o = ord(ch)
    if o < 0x250:
        return "latin" if ch.isalpha() else None
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return None


_ONLY = {s: re.compile(f"[{c}]+") for s, c in (("cyrillic", _C), ("greek", _G), ("latin", _L))}


def _kinds(w: str) -> set[str]:
    """The scripts of a word's letters."""
    if w.isascii():
        return {"latin"}
    for s, only in _ONLY.items():
        if only.fullmatch(w):
            return {s}
    return {_script(c) for c in w} - {None}


def _pairs(word: str) -> np.ndarray:
    c = np.frombuffer(f" {word.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return (mix(c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) & np.uint64(SLOTS - 1)).astype(np.int64)


def pair_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Character pairs inside and at the ends of words, over all texts."""

    def count(batch):
        for _, group in slices(batch.column(0).to_pylist()):
            c = np.frombuffer(" ".join(group).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c < 0x530) & (c != 0xD7) & (c != 0xF7))
            c = np.where(letter, c, np.uint32(32)).astype(np.uint64)
            if len(c) > 1:
                yield (mix(c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) & np.uint64(SLOTS - 1)).astype(np.int64)

    return dense_counts(df.where(F.col(text).isNotNull()).select(text), SLOTS, count)


class Former:
    """The one form of texts, with what was found out about words."""

    def __init__(self, counts: np.ndarray) -> None:
        self.logs = np.log(counts + 0.5)
        self.known: dict[tuple[str, str], str] = {}

    def word(self, word: str, home: str) -> str:
        """Viterbi over the look-alike lattice; ``home`` is the script of the text around."""
        if (got := self.known.get((word, home))) is not None:
            return got
        choices = [[(ch, _script(ch))] + [(x, s) for s, x in LIKE.get(ch, {}).items()] for ch in word]
        best: dict[tuple[str, str | None], tuple[float, str]] = {(" ", home): (0.0, "")}
        for col in choices:
            nxt: dict[tuple[str, str | None], tuple[float, str]] = {}
            for ch, s in col:
                for (prev, was), (score, path) in best.items():
                    gain = float(self.logs[_pairs(prev + ch)[1]]) if prev != " " else float(self.logs[_pairs(ch)[0]])
                    new = score + gain - (CHANGE * 0.5 if prev == " " and s != was else CHANGE if s != was else 0.0)
                    if (ch, s) not in nxt or nxt[(ch, s)][0] < new:
                        nxt[(ch, s)] = (new, path + ch)
            best = nxt
        out = max((score + float(self.logs[_pairs(ch)[-1]]), path) for (ch, _), (score, path) in best.items())[1]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[(word, home)] = out
        return out

    def form(self, text: str) -> str:
        if not _MAYBE.search(text):
            return text
        east = bool(_EAST.search(text))
        t = text.translate(_DROP).translate(_HYPHEN)
        if any(j in t for j in _JOINERS):
            # joiners are ordinary inside words of Arabic and Indic scripts only
            t = "".join(ch for i, ch in enumerate(t) if ch not in _JOINERS or (0 < i < len(t) - 1 and _JOINED.match(t[i - 1]) and _JOINED.match(t[i + 1])))
        t = _LETTERLIKE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
        if not east:
            t = _WIDE_MARK.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
            t = t.translate(_SPACE)
        else:
            t = t.translate({k: v for k, v in _SPACE.items() if k != 0x3000})
        t = t.replace("ํา", "ำ").replace("เเ", "แ")
        t = _compose(t)
        t = self._scripts(t)
        return self._arabic(t)

    def _scripts(self, t: str) -> str:
        words = _TOKEN.findall(t)
        letters: dict[str, int] = defaultdict(int)
        mixed = False
        for w in words:
            kinds = _kinds(w)
            if len(kinds) == 1:
                letters[next(iter(kinds))] += len(w)
            else:
                mixed = True
                for c in w:
                    if (s := _script(c)) is not None:
                        letters[s] += 1
        # a script that much of the text is written in is at home there
        whole = sum(letters.values())
        strange = {s for s, n in letters.items() if s != "latin" and (n < 0.2 * whole or (s == "greek" and len(letters) == 1))}
        if not mixed and not strange:
            return t

        def one(m: re.Match) -> str:
            w = m[0]
            kinds = _kinds(w)
            if not kinds:
                return w
            if len(kinds) == 1:
                s = next(iter(kinds))
                # a word wholly of look-alikes in a line of another script
                if s not in strange or not all(c in LIKE for c in w):
                    return w
                line = t[max(0, t.rfind("\n", 0, m.start())) : (t.find("\n", m.end()) + 1 or len(t) + 1) - 1]
                near = t[max(0, m.start() - 60) : m.start()] + t[m.end() : m.end() + 60]
                count = lambda part: sum(_script(c) == s for c in part)
                if count(near) > 0.15 * max(1, sum(_script(c) is not None for c in near)) and count(line) > len(w):
                    return w
                if not all("latin" in LIKE[c] for c in w):
                    return w
                return self.word(w, "latin")
            home = max(kinds, key=lambda s: (sum(_script(c) == s and c not in LIKE for c in w), sum(_script(c) == s for c in w)))
            return self.word(w, home)

        return _TOKEN.sub(one, t)

    @staticmethod
    def _arabic(t: str) -> str:
        if not any(c in t for c in _ARABIC):
            return t
        urdu = sum(t.count(c) for c in "ٹڈڑںےگچپژھہک")
        arabic = sum(t.count(c) for c in "ةإأؤىكذ") + t.count("ال")
        if urdu <= arabic:
            return t
        out = t.translate({ord(a): u for a, u in zip(_ARABIC, _URDU)})
        # in a text of both languages, lines and sentences keep to their own
        parts = re.split(r"([.!?؟۔\n]+)", t)
        if len(parts) > 1:
            out = "".join(p.translate({ord(a): u for a, u in zip(_ARABIC, _URDU)}) if _is_urdu(p) else p for p in parts)
        return out


def _is_urdu(part: str) -> bool:
    urdu = sum(part.count(c) for c in "ٹڈڑںےگچپژھہک")
    return urdu > sum(part.count(c) for c in "ةإأؤىذ") + part.count("ال")


_MARKED = re.compile("[^̀-゙゚ͯٓ-ٕ][̀-゙゚ͯٓ-ٕ]+")


def _compose(t: str) -> str:
    return _MARKED.sub(lambda m: unicodedata.normalize("NFC", m[0]), t)


def one_form(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``formed`` (the one form of the text) and ``changed``.

    Defined cases: a null text stays null and unchanged, an empty or blank one is its own form;
    repeated rows stay repeated; texts of any length are formed whole. The one form of a one form is
    itself.
    """
    counts = df.sparkSession.sparkContext.broadcast(pair_counts(df, text))

    def run(batches):
        former = Former(counts.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            formed = [None if t is None else former.form(t) for t in texts]
            changed = [f is not None and f != t for f, t in zip(formed, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(formed, pa.string()), pa.array(changed, pa.bool_())], names=[key, "formed", "changed"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, formed string, changed boolean")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return one_form(table(spark, d, "segments"), "segment_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .garbled import p3_found

    rows = table(spark, d, "segments").select("segment_id", "text", "locator_json")
    scans = F.coalesce(F.get_json_object("locator_json", "$.origin") == "ocr", F.lit(False))
    formed = one_form(rows.where(~scans & ~blank(F.col("text"))), "segment_id")
    return formed.where("changed").select("segment_id").distinct().join(p3_found(spark, d), "segment_id", "left_anti")


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
SQL: dict[str, str] = {}
