"""Text that was decoded with another encoding than the one it was written in.

A chain is a pair: read as D, written in E. Undoing it turns a word back into bytes by D and decodes
them by E. For each word with characters beyond ASCII the gain of each chain is how much better
attested its character triples become, by counts over the whole corpus. The chain of a record is
latent: expectation maximization estimates, for each source and field (media type) and without any
label, how often each chain occurs there, so evidence too weak in one record counts where its pool
shows the chain, and each record is repaired by the most probable chain. The counts are estimated
anew without the garbled records.
"""

from __future__ import annotations

import codecs
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .chars import WIDTH, slices, slots_of, spelling_scores, triple_counts
from .text import batch, blank, dense_counts

#: Encodings of one byte a character, by the letters they hold.
LATIN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5")
OTHER = ("cp1256", "iso8859_6", "cp874")
READ_LATIN = ("latin_1", "cp1254", *LATIN)
WIDE = ("euc_jp", "shift_jis", "gb18030", "big5", "euc_kr")
#: Triples, and characters beyond ASCII, of one word that count at most: a long word is not as many
#: independent witnesses.
MOST_TRIPLES, MOST_SIGNS = 4, 2
#: What valid UTF-8 adds, as it hardly comes about by chance: for one byte after a first one, for each
#: further one, and at most.
UTF8_BONUS, UTF8_MORE, UTF8_MOST = 9.0, 3.0, 18.0
#: The probability of a word to be garbled where its record is.
TOUCHED = 0.97
#: The greatest share of a chain in a pool, and the least ratio with which it can still be probable.
MOST_SHARE = 0.95
LEAST_RATIO = -math.log(MOST_SHARE / (1 - MOST_SHARE))
#: Beyond this a ratio leaves no doubt, and its exponential stays finite.
MOST_RATIO = 60.0
#: The share of a chain before any is known: so much for what was written in UTF-8, less the farther down
#: the encoding is in the lists. It only settles which of two chains is named that undo a text alike.
FIRST_SHARE = 0.002
#: Weights, in records, of a field in its sources' shares and of all records in a field's.
A_POOL, A_FIELD = 1.0, 50.0
#: Rounds end with a gain in log likelihood of less than this a record, or, should it never come, here.
LEAST_STEP, MOST_ROUNDS = 1e-3, 30
SALTS = 8
LOST = "lost"
#: Signs that no text rightly decoded has: the replacement character, and controls of the second half.
_LOST = re.compile("[\ufffd\x80-\x84\x86-\x9f]")


def _table(name: str) -> str:
    """256 characters; a byte that the encoding leaves open stands for the control of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _chains() -> list[tuple[str, str]]:
    read = ("latin_1", *LATIN, *CYRILLIC, "cp1254", *OTHER, *WIDE)
    out = [(d, "utf_8") for d in read] + [("cp1252", "utf_8*2"), ("latin_1", "utf_8*2"), ("mac_roman", "utf_8*2"), ("cp437", "utf_8*2")]
    out += [(d, e) for d in ("latin_1", *LATIN) for e in LATIN if d != e and (d, e) != ("latin_1", "iso8859_2")]
    out += [(d, e) for d in CYRILLIC for e in CYRILLIC if d != e]
    out += [(d, e) for d in ("latin_1", "cp1252", "mac_roman", "cp437") for e in (*CYRILLIC, *OTHER, *WIDE)]
    return out


CHAINS = _chains()
_ENCODE = {d: codecs.charmap_build(_table(d)) for d in {d for d, _ in CHAINS} - set(WIDE)}
#: What no repaired word has: signs and controls inside, letters of two scripts in touch.
_OTHER = "\u0370-\u06ff\u0900-\u0e7f"
_ODD = re.compile(f"[\x00-\x1f\x7f-\x9f\u0250-\u036f\u0530-\u05ff\u0700-\u08ff\u0980-\u0dff\u0e80-\u1dff\u2190-\u25ff\u2800-\u2fff\ue000-\uf8ff\ufff0-\uffff]|[A-Za-z\u00c0-\u024f][{_OTHER}]|[{_OTHER}][A-Za-z\u00c0-\u024f]")
_WIDE = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
_WIDE_RUN = re.compile("[\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5e]{2}")
_LETTER = re.compile("[A-Za-z]")
_CYRILLIC_LETTER = re.compile("[\u0400-\u04ff]")


def _plausible(word: str, chain: tuple[str, str], text: str) -> bool:
    if _ODD.search(text):
        return False
    if _WIDE.search(text) and not _WIDE_RUN.search(text):
        return False
    if chain[0] in CYRILLIC and not chain[1].startswith("utf_8"):
        return not _LETTER.search(word) and len(_CYRILLIC_LETTER.findall(text)) >= 3
    return True


def undo(word: str, chain: tuple[str, str]) -> str | None:
    """The word with the chain undone; None if the chain cannot have made it."""
    return dict(_undone(word, {chain[0]: [(-1, chain[1])]})).get(-1)


#: The characters beyond ASCII that an encoding of one byte can give, and the chains by what they were read as.
_GIVES = {d: frozenset(c for c in _table(d) if c > "\x7f") for d in _ENCODE}
_BY_READ: dict[str, list[tuple[int, str]]] = {}
#: Of chains of one byte a character, the characters that become something a word may have.
_SOUND: dict[int, frozenset[str]] = {}
for _i, (_d, _e) in enumerate(CHAINS):
    _BY_READ.setdefault(_d, []).append((_i, _e))
    if _e in (*LATIN, *CYRILLIC, *OTHER):
        _into = {c: bytes([b]).decode(_e, "ignore") for b, c in enumerate(_table(_d)) if c > "\x7f"}
        _SOUND[_i] = frozenset(c for c, t in _into.items() if t and not _ODD.search(t))


def _undone(word: str, by_read: dict[str, list[tuple[int, str]]]):
    """Numbers of chains that can have made the word, each with what it was before."""
    beyond = {c for c in word if c > "\x7f"}
    for d, written in by_read.items():
        if d in _GIVES and not beyond <= _GIVES[d]:
            continue
        try:
            raw = word.encode(d) if d in WIDE else codecs.charmap_encode(word, "strict", _ENCODE[d])[0]
        except UnicodeError:
            continue
        for i, e in written:
            if i in _SOUND and not beyond <= _SOUND[i]:
                continue
            try:
                if e.endswith("*2"):
                    yield i, codecs.charmap_encode(raw.decode("utf_8"), "strict", _ENCODE[d])[0].decode("utf_8")
                else:
                    yield i, raw.decode(e)
            except UnicodeError:
                continue


class Judge:
    """Gains of words under chains, kept between batches.

    The gain is a log likelihood ratio of two spellings: how much better attested the triples of the
    word become, and its characters beyond ASCII between their neighbours. It is below 0 where the
    chain makes a word worse, but not far, as a word of a garbled record is under the chain with
    probability ``TOUCHED`` only.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.known: dict[str, dict[int, tuple[float, str]]] = {}
        #: The chains of each word that alone would leave its record in question.
        self.likely: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) > 200_000:
            self.known.clear()
            self.likely.clear()
        own, _, own_set, _ = spelling_scores(words, self.counts)
        who, chain, text = [], [], []
        for i, w in enumerate(words):
            for c, t in _undone(w, _BY_READ):
                if t != w and "\n" not in t and " " not in t and _plausible(w, CHAINS[c], t):
                    who.append(i)
                    chain.append(c)
                    text.append(t)
            self.known[w] = {}
        new, n_new, new_set, n_set = spelling_scores(text, self.counts)
        for i, c, t, s, n, x, k in zip(who, chain, text, new, n_new, new_set, n_set):
            # what becomes plain ASCII is not attested by these counts
            if n == 0:
                continue
            gain = float(s - own[i]) * min(float(n), MOST_TRIPLES) + float(x - own_set[i]) * min(float(k), MOST_SIGNS)
            if CHAINS[c][1].startswith("utf_8"):
                # in encodings of other scripts ordinary words make valid UTF-8 now and then
                if CHAINS[c][0] not in READ_LATIN and (gain <= UTF8_BONUS or s <= 1.0):
                    continue
                gain += min(UTF8_BONUS + UTF8_MORE * (len(words[i]) - len(t) - 1), UTF8_MOST)
            gain = math.log1p(TOUCHED * math.expm1(gain)) if gain < 30 else gain
            self.known[words[i]][c] = (gain, t)
            if gain > LEAST_RATIO:
                self.likely.setdefault(words[i], []).append(c)

    def gains(self, texts: list[str]) -> list[dict[int, tuple[float, str]]]:
        new = list(dict.fromkeys(w for w in texts if w not in self.known))
        if new:
            kept = [w for w in texts if w in self.known] if len(self.known) + len(new) > 200_000 else []
            self.learn(new + list(dict.fromkeys(kept)))
        return [self.known[w] for w in texts]


#: Words with characters beyond ASCII. A no-break space behind one may be a byte of it, any other is a blank. Where East Asian text touches other text, each is a word, and the
#: quotation marks and dashes that touch East Asian text are part of it.
_EAST = "\u3000-\u30ff\u3400-\u9fff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f"
_SIGNS = "\u2010-\u2027\xb7"
_INNER = rf" \n\r\t\xa0\u2000-\u200b\u202f\u205f{_EAST}"
_HARD_BLANK = r"(?<=[^\x00-\x7f])\xa0"
_WORD = re.compile(rf"[{_SIGNS}]*[{_EAST}][{_EAST}{_SIGNS}]*|[^{_INNER}]*[^\x00-\x7f{_INNER}](?:[^{_INNER}]|{_HARD_BLANK})*")


def evidence(texts: list[str], judge: Judge) -> list[dict[int, float]]:
    """For each text the log likelihood ratios of the chains that may have touched it: the sums over its
    words. Chains that no share could make probable are left out."""
    found = [_WORD.findall(t) for t in texts]
    judge.gains([w for ws in found for w in ws])
    out = []
    for ws in found:
        chains = {c for w in ws for c in judge.likely.get(w, ())}
        total = {c: 0.0 for c in sorted(chains)}
        for w in ws if chains else ():
            of = judge.known[w]
            for c in chains & of.keys():
                total[c] += of[c][0]
        out.append({c: g for c, g in total.items() if g > LEAST_RATIO})
    return out


def repaired(text: str, chain: int, judge: Judge) -> str:
    """The text with each word that the chain can have made undone where that makes it no worse."""
    words = _WORD.findall(text)
    undone = {w: g[chain][1] for w, g in zip(words, judge.gains(words)) if chain in g and g[chain][0] > LEAST_RATIO}
    return _WORD.sub(lambda m: undone.get(m[0], m[0]), text)


def _pool(c: Column) -> Column:
    p = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")))
    return F.when(p == "", "none").otherwise(p)


def garbled(df: DataFrame, key: str, text: str = "text", source: str = "source_name", field: str = "media_type") -> tuple[DataFrame, np.ndarray]:
    """Records with wrongly decoded characters: ``key``, ``chain`` (a number of ``CHAINS``, or -1 where
    only lost characters tell) and ``posterior``; and the counts they were judged by.

    Two rounds: the first estimates the chains' shares by the counts of all text; then the garbled
    records are taken out of the counts, their repaired texts are put in, and the second round judges
    all records again, as wrong spellings that repeat look attested otherwise.

    Defined cases: null and blank texts are intact; a record repeated in full counts once (its pool's
    size counts all rows); null pool values form a pool of their own; a text with U+FFFD, or with
    controls of the second half, which no decoder that fits gives, is garbled whatever the counts say.
    An empty table gives none.
    """
    rows = df.where(F.col(key).isNotNull() & ~blank(F.col(text)) & F.col(text).rlike("[^\\x00-\\x7f]"))
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), _pool(F.col(source)).alias("source"), _pool(F.col(field)).alias("field"))
    sizes = cut(rows.groupBy("field", "source").agg(F.count("*").alias("size")))
    fields = cut(sizes.groupBy("field").agg(F.sum("size").alias("field_size")))
    everything = float(fields.agg(F.sum("field_size")).first()[0] or 0)
    counts = triple_counts(rows)
    found = _evidence(rows, counts)
    state = _maximize(found.drop("text"), sizes, fields, everything, None)
    sc = df.sparkSession.sparkContext
    old = sc.broadcast(counts)

    def taken(b):
        for _, group in slices(b.column(0).to_pylist()):
            yield from slots_of(group)

    def put(b):
        texts = b.column(0).to_pylist()
        judge = Judge(old.value)
        judge.gains([w for t in texts for w in _WORD.findall(t)])
        for _, group in slices([repaired(t, c, judge) for t, c in zip(texts, b.column(1).to_pylist())]):
            yield from slots_of(group)

    bad = cut(_best(state).where(F.col("posterior") > 0.5).join(found.select("key", "text"), "key").select("text", "chain"))
    counts = np.maximum(counts - dense_counts(bad, WIDTH, taken) + dense_counts(bad, WIDTH, put), 0).astype(np.float32)
    state = _maximize(_evidence(rows, counts).drop("text"), sizes, fields, everything, state)
    return _best(state).where(F.col("posterior") > 0.5).select("key", "chain", "posterior"), counts


def _evidence(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """Records that any chain may have touched, each with its chains and their log ratios."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        judge = Judge(shared.value)
        for b in batches:
            keys, texts, sources, fields = (b.column(i).to_pylist() for i in range(4))
            got = {k: [] for k in ("key", "text", "source", "field", "certain", "chains", "gains")}
            for start, group in slices(texts):
                for i, total in enumerate(evidence(group, judge), start):
                    certain = _LOST.search(texts[i]) is not None
                    if not total and certain:
                        total = {-1: 0.0}
                    if total:
                        for name, v in zip(got, (keys[i], texts[i], sources[i], fields[i], certain, list(total), [min(g, MOST_RATIO) for g in total.values()])):
                            got[name].append(v)
            yield batch(got, certain=pa.bool_(), chains=pa.list_(pa.int32()), gains=pa.list_(pa.float64()))

    found = rows.mapInArrow(run, "key string, text string, source string, field string, certain boolean, chains array<int>, gains array<double>")
    return cut(found.dropDuplicates(["key"]))


def _maximize(found: DataFrame, sizes: DataFrame, fields: DataFrame, everything: float, before: DataFrame | None) -> DataFrame:
    """Expectation maximization over the shares of the chains in each source and field.

    A chain's share in a source (of one field) leans on its share in the field, and that on its share
    in all records. A record is judged by the shares that the others of its pool give, so that it does
    not bear witness to itself. What is exchanged are sums of responsibilities per pool and chain, added
    up where the records are; a pool's records are spread over ``SALTS`` parts, so a hot one is no task
    of its own. Rounds end where the log likelihood of all records gains less than ``LEAST_STEP`` a record.
    """
    found = found.withColumn("salt", F.abs(F.hash("key")) % SALTS)
    state, last = before, None
    base = _base(before, everything)[0] if before is not None else None
    for _ in range(MOST_ROUNDS):
        known = _shares(found, state, base, sizes, fields, everything)
        own = F.col("weights") if "weights" in found.columns else F.transform("chains", lambda c: F.lit(0.0))
        zipped = F.arrays_zip("chains", "gains", own.alias("own"))
        share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(MOST_SHARE), (F.coalesce(F.col("pool")[x["chains"]], F.lit(0.0)) - x["own"] + A_POOL * F.coalesce(F.col("prior")[x["chains"]], F.col("rare"))) / (F.col("size") - 1 + A_POOL)))
        known = known.withColumn("zipped", zipped)
        known = known.withColumn("odds", F.transform("zipped", lambda x: F.exp(x["gains"]) * share(x)))
        known = known.withColumn("mine", F.aggregate("zipped", F.lit(0.0), lambda s, x: s + x["own"]))
        intact = F.greatest(F.lit(1 - MOST_SHARE), 1 - (F.col("all") - F.col("mine") + A_POOL * F.col("prior_all")) / (F.col("size") - 1 + A_POOL))
        known = known.withColumn("intact", F.when(F.col("certain"), 1e-12).otherwise(intact))
        known = known.withColumn("total", F.col("intact") + F.aggregate("odds", F.lit(0.0), lambda s, x: s + x))
        state = found = cut(known.select("key", "source", "field", "certain", "chains", "gains", "salt", F.transform("odds", lambda x: x / F.col("total")).alias("weights"), F.log("total").alias("likelihood")))
        base, now = _base(state, everything)
        if last is not None and now - last < LEAST_STEP * everything:
            break
        last = now
    return state


def _base(state: DataFrame, everything: float) -> tuple[dict[int, float], float]:
    """The share of each chain in all records, and the log likelihood: a number for each of a fixed list of
    chains, and one more."""
    each = F.explode(F.concat(F.arrays_zip("chains", "weights"), F.array(F.struct(F.lit(None).cast("int").alias("chains"), F.col("likelihood").alias("weights")))))
    sums = {r["chain"]: r["w"] for r in state.select(each.alias("x")).groupBy(F.col("x.chains").alias("chain")).agg(F.sum("x.weights").alias("w")).collect()}
    likelihood = float(sums.pop(None, None) or 0.0)
    return {c: w / (everything + 1) for c, w in sums.items()}, likelihood


def _shares(found: DataFrame, state: DataFrame | None, base: dict[int, float] | None, sizes: DataFrame, fields: DataFrame, everything: float) -> DataFrame:
    """``found`` with what its pools say: ``pool`` (sums by chain), ``all`` (their sum), ``size``,
    ``prior`` (shares by chain in the field), ``prior_all`` (their sum) and ``rare`` (that of any other chain)."""
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt")
    if state is None:
        order = ["utf_8", "utf_8*2", *LATIN, *CYRILLIC, *OTHER, *WIDE]
        first = [FIRST_SHARE / (1 + order.index(e)) for _, e in CHAINS]
        pools = sizes.select("field", "source", "size", F.lit(None).cast("map<int,double>").alias("pool"), F.lit(0.0).alias("all"))
        prior = F.create_map(*(F.lit(v) for c, x in enumerate(first) for v in (c, x)))
        priors = fields.select("field", prior.alias("prior"), F.lit(10 * FIRST_SHARE).alias("prior_all"), F.lit(FIRST_SHARE).alias("rare"))
    else:
        mass = state.select("field", "source", F.explode(F.arrays_zip("chains", "weights")).alias("x")).groupBy("field", "source", F.col("x.chains").alias("chain")).agg(F.sum("x.weights").alias("w"))
        by = mass.groupBy("field", "chain").agg(F.sum("w").alias("w"))
        bases = F.create_map(*(F.lit(v) for c, x in base.items() for v in (c, x))) if base else F.lit(None).cast("map<int,double>")
        pools = sizes.join(mass.groupBy("field", "source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "w"))).alias("pool"), F.sum("w").alias("all")), ["field", "source"], "left").withColumn("all", F.coalesce("all", F.lit(0.0)))
        seen = fields.join(by.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "w"))).alias("seen")), "field", "left")
        lean = lambda c, b: (F.coalesce(F.col("seen")[c], F.lit(0.0)) + A_FIELD * b) / (F.col("field_size") + A_FIELD)
        # a chain that no record has shown yet may still turn up
        rare = FIRST_SHARE / (everything + 1)
        priors = seen.select("field", F.transform_values(bases, lean).alias("prior"), F.lit(rare).alias("rare"))
        priors = priors.withColumn("prior_all", F.coalesce(F.aggregate(F.map_values("prior"), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    known = pools.join(priors, "field").select("*", salts)
    return found.join(known, ["field", "source", "salt"])


def _best(state: DataFrame) -> DataFrame:
    """The most probable chain of each record and the probability that any chain touched it."""
    first = F.array_max(F.transform(F.arrays_zip("weights", "chains"), lambda x: F.struct(x["weights"].alias("w"), (-x["chains"]).alias("c"))))
    return state.select("key", (-first["c"]).alias("chain"), F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).alias("posterior"))


def _garbled_segments(spark: SparkSession, d: str):
    return garbled(table(spark, d, "segments"), "segment_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled_segments(spark, d)[0].select(F.col("key").alias("segment_id"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled segments with the chain and, where it is known, the restored text."""
    best, counts = _garbled_segments(spark, d)
    best = cut(best)
    shared = spark.sparkContext.broadcast(counts)
    rows = table(spark, d, "segments").select("segment_id", "text").join(best.withColumnRenamed("key", "segment_id"), "segment_id").dropDuplicates(["segment_id"])

    def run(batches):
        judge = Judge(shared.value)
        for b in batches:
            key, texts, chain, posterior = (b.column(i).to_pylist() for i in range(4))
            judge.gains([w for t in texts for w in _WORD.findall(t)])
            yield batch({
                "segment_id": key,
                "chain": [LOST if c < 0 else f"{CHAINS[c][1]} read as {CHAINS[c][0]}" for c in chain],
                "posterior": [round(p, 6) for p in posterior],
                "restored": [None if c < 0 else repaired(t, c, judge) for t, c in zip(texts, chain)],
            }, posterior=pa.float64())

    return rows.select("segment_id", "text", "chain", "posterior").mapInArrow(run, "segment_id string, chain string, posterior double, restored string")


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
SQL: dict[str, str] = {}
