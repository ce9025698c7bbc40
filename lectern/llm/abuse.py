"""Scores for abusive, hateful and sexually explicit language.

Dense features of the most suspicious sentence of a text and of the text as a whole - densities of
word lists, the nearness of address, capitals, punctuation, disguise - go into gradient-boosted trees,
and an isotonic fit on out-of-fold scores turns their output into a probability. Words that labels
mark out add a learned list to the written one. All is trained here, on at most ``TRAIN_DOCS`` reviewed
documents.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .lookalike import SLOTS as PAIR_SLOTS
from .lookalike import Former

TRAIN_DOCS, TRAIN_CHARS = 5_000, 100_000_000
FOLDS = 5
#: What one learned word counts at most, as a word may owe its log odds to a handful of labels.
MOST_WEIGHT = 3.0
#: A document is reported from this calibrated score.
REPORTED = 0.5

#: Words that insult, threaten, degrade and describe sex; a final * stands for any ending.
LISTS = {
    "insult": "idiot* moron* imbecil* cretin* stupid* dumb* loser* scum* parasite* asshole* arsehole* bastard* bitch* dickhead* wanker* twat shit* worthless brainless pathetic useless filthy miserable pig pigs trottel dummkopf schwachkopf mistkerl arschloch drecksack* depp idiotin abschaum connard* salaud* abruti* débile* crétin* imbécile* ordure* merde enfoiré* gilipollas idiota* imbécil* desgraciad* cabrón* estúpid* inútil* mierda stronzo cretino coglione idioot klootzak",
    "threat": "kill* die dead drown choke rot burn* break* beat* hang* shoot* stab* hurt* suffer* destroy* verreck* krepier* umbring* töten erschlagen brechen anzünden verbrennen crève* crever brûler tuer mourir casser étrangl* muer* matar quemar romper ahog* pudr* breathe",
    "degrade": "vermin rat rats thieves thief breed subhuman* animals cockroach* filth savages criminals migrants believers ungeziefer diebe geborene vertrieben gehören parasiten ratten pack vermine voleurs rats naissance chasser alimañas ladrones nacimiento echarlos ratas plaga driven hire",
    "sexual": "naked nude sex cock cocks orgasm* moan* lick* thigh* breast* skin fuck* nipple* penis vagina nackt* brüst* orgasmus stöhnt* leckte schenkel nus nues nu seins gémi* léch* baiser cuisses desnud* pechos gemía gemido* lamió lamía muslos follar",
    "you": "you your yours yourself du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros su nobody everyone someone",
    "all": "all every those these people everyone nobody never always whole alle jeder man diese solche tous toutes ces gens on todos todas esos esas gente nadie",
    "must": "should must deserve* will would hope wish ought allowed sollte sollten müssen muss gehören devrait devraient faut mérite* ojalá debería* habría hay merece*",
    "neutral": "policy rule rules annex note form report* regulation* against complaint* harassment training leaflet study collection map control return* recorded records repair norm norma dienstanweisung gegen gilt règles contre rappelle affiche reglamento sigue vigente seguro insured gemeldet plan apologised",
}
NAMES = (*LISTS, "disguised", "learned", "learned_best", "words", "code", "capitals", "marks", "near", "sum_insult", "sum_threat", "sum_degrade", "sum_sexual", "sentences_hit", "strong", "strong_you")
_HARD = ("insult", "threat", "degrade", "sexual")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+|\n|$)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
_MASKED = re.compile(r"(?<![\w*/.-])[^\W\d_]*[*#@$!0134578]+[a-zà-ÿ*@$!0134578]*[a-zà-ÿ$](?![\w/-])|(?<![\w*/.-])[^\W\d_]+[*#@$0134578]+(?=[ ,.!?;:]|$)")
_HINT = re.compile(r"[*$@]|[^\W\d_]#|#[^\W\d_]|[0134578!][a-zà-ÿ]|[a-zà-ÿ][0134578]|\b[^\W\d_][ .\-_][^\W\d_][ .\-_][^\W\d_][ .\-_][^\W\d_]\b")
_CODE = re.compile(r"[A-Z]{1,2}-?\d+|\d+/\d+|\d+\.\d+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_TWICE = re.compile(r"(.)\1+")


@cache
def _index() -> tuple[dict[str, int], dict[str, int], set[str]]:
    """Whole words and stems with the bits of their lists; forms with letters once."""
    whole: dict[str, int] = {}
    stems: dict[str, int] = {}
    for bit, words in enumerate(LISTS.values()):
        for w in words.split():
            into, w = (stems, w[:-1]) if w.endswith("*") else (whole, w)
            into[w] = into.get(w, 0) | 1 << bit
    return whole, stems, {_TWICE.sub(r"\1", w) for w in (*whole, *stems)}


class Lexicon:
    """Bits of words, kept as they are met."""

    def __init__(self) -> None:
        self.whole, self.stems, self.once = _index()
        self.longest = max(map(len, self.stems))
        self.known: dict[str, int] = {}
        self.hard = sum(1 << i for i, n in enumerate(LISTS) if n in _HARD)

    def bits(self, w: str) -> int:
        got = self.known.get(w)
        if got is None:
            got = self.whole.get(w, 0)
            for n in range(3, min(len(w), self.longest) + 1):
                got |= self.stems.get(w[:n], 0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[w] = got
        return got

    def undisguised(self, token: str) -> str | None:
        """The listed word behind a token with masks, other signs for letters or doubled letters."""
        t = token.lower()
        if "*" in t or "#" in t:
            pattern = re.compile(re.escape(t.translate(_LEET)).replace(r"\*", ".").replace(r"\#", "."))
            for w in (*self.whole, *self.stems):
                if len(w) > 3 and self.bits(w) & self.hard and (pattern.fullmatch(w) or (w in self.stems and len(t) >= len(w) and pattern.match(w.ljust(len(t), "x")) is None and re.match(re.escape(t[: len(w)]).replace(r"\*", ".").replace(r"\#", ".") + "$", w))):
                    return w
            return None
        for plain in (t.translate(_LEET), t.translate(str.maketrans("1", "l")).translate(_LEET)):
            if self.bits(plain) & self.hard:
                return plain
        once = _TWICE.sub(r"\1", t.translate(_LEET))
        return once if once != t and len(once) > 3 and self.bits(once) & self.hard else None


class Features:
    """Features of texts under a learned list of words."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.lexicon, self.weights = Lexicon(), weights
        self.former = Former(np.zeros(PAIR_SLOTS))
        self.marks: dict[str, tuple[int, float]] = {}
        #: Words, as written, none of which stands out.
        self.cold: set[str] = set()

    def mark(self, w: str) -> tuple[int, float]:
        """Bits and learned weight of a word, kept as words are met."""
        got = self.marks.get(w)
        if got is None:
            got = self.lexicon.bits(w), min(self.weights.get(w, 0.0), MOST_WEIGHT)
            if not got[0] & self.lexicon.hard and len(w) > 4 and (once := _TWICE.sub(r"\1", w)) != w and once in self.lexicon.once and w not in self.weights:
                got = self.lexicon.bits(once) | 1 << 30 if self.lexicon.bits(once) & self.lexicon.hard else got[0], got[1]
            if len(self.marks) > 300_000:
                self.marks.clear()
            self.marks[w] = got
        return got

    def sentence(self, raw: str, hints: bool = True) -> tuple[float, list[float]] | None:
        """Rank and features of a sentence; None if no word of it stands out."""
        mark, hard_bits = self.mark, self.lexicon.hard
        hint = hints and bool(_HINT.search(raw))
        if not hint and self.cold.issuperset(_WORD.findall(raw)):
            return None
        low = raw.lower()
        disguised = 0
        for m in _SPACED.findall(low):
            joined = re.sub(r"[ .\-_]", "", m)
            if self.lexicon.bits(joined) & hard_bits or joined in self.weights or len(joined) > 4:
                low = low.replace(m, joined)
                disguised += 1
        words = _WORD.findall(low)
        for t in _MASKED.findall(raw) if hint else ():
            w = self.lexicon.undisguised(t.strip(".,;:"))
            if w:
                words.append(w)
                disguised += 1
        got = [mark(w) for w in words]
        if not any(b & hard_bits or x > 0.5 for b, x in got):
            if not hint:
                if len(self.cold) > 300_000:
                    self.cold.clear()
                for w in _WORD.findall(raw):
                    b, x = mark(w.lower())
                    if not b & hard_bits and x <= 0.5:
                        self.cold.add(w)
            return None
        bits = [b for b, _ in got]
        disguised += sum(b >> 30 & 1 for b in bits)
        counts = [sum(b >> k & 1 for b in bits) for k in range(len(LISTS))]
        learned = sorted({w: x for w, (_, x) in zip(words, got)}.values(), reverse=True)
        hard = [i for i, b in enumerate(bits) if b & hard_bits]
        you = [i for i, b in enumerate(bits) if b >> 4 & 1]
        near = min((abs(i - j) for i in hard for j in you), default=20)
        letters = [c for c in raw if c.isalpha()]
        first = low.find(words[hard[0]]) if hard else 0
        strong = sum(counts[:4])
        row = [
            *(float(c) for c in counts), float(disguised), float(sum(learned)), float(learned[0]), float(len(words)),
            float(bool(_CODE.search(raw, max(0, first)))), sum(c.isupper() for c in letters) / max(1, len(letters)), float(raw.count("!") + raw.count("*")), float(min(near, 20)),
        ]
        rank = strong * 1.5 + sum(learned) + counts[4] + disguised * 2 - counts[7] - 2.0 * row[12]
        return rank, row

    def row(self, text: str | None) -> list[float]:
        """Features of a text; all zero for a null, empty or blank one and where nothing stands out."""
        empty = [0.0] * len(NAMES)
        if not text or text.isspace():
            return empty
        best, best_rank = None, -1e9
        sums = np.zeros(4)
        hit = 0
        text = self.former.form(text)
        hints = bool(_HINT.search(text))
        for m in _SENTENCE.findall(text):
            got = self.sentence(m, hints)
            if got is None:
                continue
            rank, row = got
            if rank > best_rank:
                best, best_rank = row, rank
            if any(row[:4]):
                sums += row[:4]
                hit += 1
        if best is None:
            return empty
        strong = sum(best[:4])
        return [*best, *sums.tolist(), float(hit), strong, strong * (best[4] > 0)]


class Vocabulary:
    """Which words stand in which of the sample's texts, read once for all folds."""

    def __init__(self, texts: list[str]) -> None:
        number: dict[str, int] = {}
        owner, word = [], []
        for i, t in enumerate(texts):
            for w in set(_WORD.findall(t.lower())):
                owner.append(i)
                word.append(number.setdefault(w, len(number)))
        self.words = list(number)
        self.owner, self.word = np.array(owner, dtype=np.int64), np.array(word, dtype=np.int64)

    def learned(self, y: np.ndarray, use: np.ndarray) -> dict[str, float]:
        """Words that occur more in texts of label 1, with their log odds, among the texts in use."""
        n = len(self.words)
        here = use[self.owner]
        p = np.bincount(self.word[here], weights=y[self.owner[here]], minlength=n)
        q = np.bincount(self.word[here], minlength=n) - p
        pos, neg = y[use].sum(), (1 - y[use]).sum()
        odds = np.log((p + 0.3) / (pos + 1.0)) - np.log((q + 0.7) / (neg + 1.0))
        return {self.words[i]: float(odds[i] - 1.0) for i in np.flatnonzero((p >= 2) & (odds > 1.2)) if len(self.words[i]) > 1}


class Boosted:
    """Gradient-boosted regression trees of logistic loss over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.forest: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.edges = [np.unique(np.concatenate([e, [0.5, 1.5]])) for e in self.edges]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            s = 1 / (1 + np.exp(-f))
            g, h = y - s, s * (1 - s)
            tree, leaf = self._grow(b, g, h)
            self.forest.append(tree)
            f += leaf
        return self

    def _grow(self, b, g, h):
        size = 2 ** (self.depth + 1) - 1
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * size
        node = np.zeros(len(g), dtype=np.int64)
        out = np.zeros(len(g))
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value = self.rate * gs / (hs + 1.0)
            tree[at] = (-1, 0.0, value)
            best = (1e-3, -1, 0)
            if at < 2**self.depth - 1:
                for k, e in enumerate(self.edges):
                    gb = np.bincount(b[rows, k], weights=g[rows], minlength=len(e) + 1).cumsum()[:-1]
                    hb = np.bincount(b[rows, k], weights=h[rows], minlength=len(e) + 1).cumsum()[:-1]
                    nb = np.bincount(b[rows, k], minlength=len(e) + 1).cumsum()[:-1]
                    ok = (nb >= self.least) & (len(rows) - nb >= self.least)
                    gain = np.where(ok, gb**2 / (hb + 1.0) + (gs - gb) ** 2 / (hs - hb + 1.0) - gs**2 / (hs + 1.0), 0.0)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
            if best[1] >= 0:
                _, k, cut = best
                tree[at] = (k, float(self.edges[k][cut]), value)
                node[rows] = np.where(b[rows, k] <= cut, 2 * at + 1, 2 * at + 2)
            else:
                out[rows] = value
        return tree, out

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.forest:
            node = np.zeros(len(x), dtype=np.int64)
            feature = np.array([t[0] for t in tree])
            edge, value = np.array([t[1] for t in tree]), np.array([t[2] for t in tree])
            for _ in range(self.depth):
                k = feature[node]
                go = k >= 0
                right = x[np.arange(len(x)), np.maximum(k, 0)] > edge[node]
                node = np.where(go, 2 * node + 1 + right, node)
            f += value[node]
        return f


class Isotonic:
    """The nondecreasing step function nearest to the labels (pool adjacent violators)."""

    def fit(self, f: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(f, kind="stable")
        blocks: list[list[float]] = []
        for x, v in zip(f[order], y[order]):
            blocks.append([float(v), 1.0, float(x)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, top = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += n
                blocks[-1][2] = top
        self.x = np.array([b[2] for b in blocks])
        self.y = np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])
        return self

    def of(self, f: np.ndarray) -> np.ndarray:
        return np.interp(f, self.x, self.y) if len(self.x) else np.zeros(len(f))


class Model:
    def __init__(self, texts: list[str], labels: list[int]) -> None:
        y = np.array(labels, dtype=np.float64)
        self.trained = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.trained:
            self.weights: dict[str, float] = {}
            return
        # equal texts stay in one fold; within the sample each counts once
        fold = np.array([hash_of(t) % FOLDS for t in texts])
        words = Vocabulary(texts)
        x, f = np.zeros((len(y), len(NAMES))), np.zeros(len(y))
        for k in range(FOLDS):
            rest = fold != k
            features = Features(words.learned(y, rest))
            for i in np.flatnonzero(~rest):
                x[i] = features.row(texts[i])
        for k in range(FOLDS):
            rest = fold != k
            if 0 < y[rest].sum() < rest.sum():
                f[~rest] = Boosted().fit(x[rest], y[rest]).raw(x[~rest])
        self.weights = words.learned(y, np.ones(len(y), dtype=bool))
        self.trees = Boosted().fit(x, y)
        self.scale = Isotonic().fit(f, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scale.of(self.trees.raw(x)) if self.trained else np.zeros(len(x))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of about ``TRAIN_DOCS`` reviewed documents at most, of ``TRAIN_CHARS`` characters in all, taken
    whole and by hash; reviewers vote, ties and documents with null labels only take no part."""
    votes = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).distinct().groupBy("doc_id").agg(F.avg((F.col("label") != "none").cast("int")).alias("bad")).where("bad <> 0.5")
    part = min(1.0, TRAIN_DOCS / max(1, votes.count()))
    votes = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part * 1_000_003)
    reviewed = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(votes, "doc_id")
    chars = reviewed.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    rows = reviewed.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) < min(1.0, TRAIN_CHARS / max(1, chars)) * 1_000_003)
    rows = rows.limit(2 * TRAIN_DOCS).toPandas().sort_values("doc_id").drop_duplicates("text")
    return Model(rows["text"].tolist(), (rows["bad"] > 0.5).astype(int).tolist())


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``score`` (0 to 1) of each document.

    Defined cases: null, empty and blank texts score 0; without usable labels all scores are 0;
    copies under other ids are scored each; texts of any length are read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        m = model.value
        features = Features(m.weights)
        for b in batches:
            texts = b.column(2).to_pylist()
            x = np.array([features.row(t) for t in texts]).reshape(-1, len(NAMES))
            score = m.score(x) * np.array([bool(t) and not t.isspace() for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["doc_id", "source", "score"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= REPORTED).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source (null for documents without one): documents, reported ones, their rate, mean score."""
    bad = (F.col("score") >= REPORTED).cast("int")
    return _scores(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(bad).alias("reported"), F.round(F.avg(bad), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
