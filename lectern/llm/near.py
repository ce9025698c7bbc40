"""Near-duplicate texts: all pairs of word-shingle sets with a similarity of a threshold or more.

Texts with equal shingle sets form a class, and only classes are compared. Two similar sets share at
least one of their rarest shingles (as many as the threshold leaves), so each class is posted under
those; postings that no other class shares fall away. What remains of a posting list is the root of a
signature tree: nodes hold the OR of their members' token bitmaps and ranges of their sizes, and two
trees are walked together, leaving out pairs of nodes whose greatest possible overlap is too small for
the threshold. Surviving pairs are verified with the exact sets. Nothing is approximate: no pair of the
threshold is lost.

A posting list may be long. Lists of more than ``BLOCK`` postings, by an exact count, are dealt into
blocks, and each pair of blocks is a list of its own, so no task has to hold more than two blocks. Only
lists that the counters of fixed width can't rule out are counted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import bloom_of, might_contain
from ..session import cut, table
from .text import dense_counts, mix, ragged, white_words, within

BUCKETS = 1 << 20
BLOCK = 4096
#: Long lists that are told to all executors at most, 16 bytes each.
MOST_BROADCAST = 1 << 20
#: Members of a class from which it is spread over several tasks where pairs are written out.
HOT = 1000
LEAF, FANOUT = 16, 8
WORDS = 4  # of 64 bits in a bitmap
_ONE = np.uint64(1)


def shingle_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key``, ``cls`` (16 bytes that stand for the set), ``k`` (8 of them), ``n`` and ``sh`` (the
    set, in order).

    A text of fewer than ``width`` words has the one shingle of all its words; a text without words
    has the empty set's class and is alike only to its copies.
    """
    kind = df.schema[key].dataType.simpleString()
    factors = mix(np.arange(11, 11 + width, dtype=np.uint64)) | _ONE

    def run(batches):
        for b in batches:
            words, borders = ragged(b.column(1))
            words = words.view(np.uint64)
            sizes = np.diff(borders)
            n = np.maximum(sizes - width + 1, np.minimum(sizes, 1))
            at = np.repeat(borders[:-1], n) + within(n)
            end = np.repeat(borders[1:], n)
            h = np.zeros(len(at), dtype=np.uint64)
            for i in range(width):
                inside = at + i < end
                h = mix(h + np.where(inside, words[np.minimum(at + i, max(0, len(words) - 1))], np.uint64(0)) * factors[i]) if len(words) else h
            row = np.repeat(np.arange(b.num_rows), n)
            order = np.lexsort((h.view(np.int64), row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            n = np.bincount(row, minlength=b.num_rows)
            borders = np.concatenate([[0], np.cumsum(n)])
            sums = np.zeros((b.num_rows, 2), dtype=np.uint64)
            some = n > 0
            if len(h):
                sums[some, 0] = np.add.reduceat(mix(h), borders[:-1][some])
                sums[some, 1] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), borders[:-1][some])
            cls = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b.num_rows, [None, pa.py_buffer(sums.tobytes())]).cast(pa.binary())
            sh = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), cls, pa.array(sums[:, 0].copy().view(np.int64)), pa.array(n.astype(np.int32)), sh], names=[key, "cls", "k", "n", "sh"])

    return df.select(key, F.coalesce(white_words(F.col(text)), F.array().cast("array<bigint>")).alias("w")).mapInArrow(run, f"`{key}` {kind}, cls binary, k bigint, n int, sh array<bigint>")


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each of ``BUCKETS`` buckets, over all classes.

    Counted where the sets are; what reaches the driver is ``BUCKETS`` numbers at most. The counts
    rank shingles, and no posting list is longer than its bucket; a shared bucket costs time, never a pair.
    """
    return dense_counts(sets.select("sh"), BUCKETS, lambda b: [ragged(b.column(0))[0].view(np.uint64).astype(np.int64) & (BUCKETS - 1)])


def _postings(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """The rarest shingles of each class, and which of them may have a long list."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        count = shared.value
        for b in batches:
            h, borders = ragged(b.column(1))
            h = h.view(np.uint64)
            n = np.diff(borders)
            row = np.repeat(np.arange(b.num_rows), n)
            c = count[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
            order = np.lexsort((h, c, row))
            keep = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            order = order[within(n) < np.repeat(keep, n)]
            yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(b.column(0).to_numpy()[row[order]]), pa.array(c[order] > BLOCK)], names=["h", "k", "suspect"])

    return sets.select("k", "sh").mapInArrow(run, "h bigint, k bigint, suspect boolean")


def dealt(posted: DataFrame, block: int) -> DataFrame:
    """Postings ``h``, ``pair``, ``side``, ``k``; those of long lists once for each pair of blocks that they
    are in. A pair of a block with itself has side 0, of two blocks 1 and 2."""
    plain = posted.select("h", F.lit(0).cast("bigint").alias("pair"), F.lit(0).cast("tinyint").alias("side"), "k")
    long = cut(posted.where("suspect").groupBy("h").agg(F.count("*").alias("length")).where(F.col("length") > block))
    many = long.count()
    if not many:
        return plain
    blocks = long.select("h", F.ceil(F.col("length") / block).alias("blocks"))
    # 16 bytes a list: broadcast as long as that is bounded, joined by exchange beyond
    joined = posted.join(F.broadcast(blocks) if many <= MOST_BROADCAST else blocks, "h", "left")
    mine = F.pmod(F.xxhash64("k", "h"), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    spread = joined.select("h", "k", "blocks", mine.alias("mine"), F.explode(others).alias("other"))
    pair = 1 + F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return spread.select("h", F.when(F.col("blocks").isNull(), 0).otherwise(pair).cast("bigint").alias("pair"), F.when(F.col("blocks").isNull(), 0).otherwise(side).cast("tinyint").alias("side"), "k")


def _signatures(sets: DataFrame) -> DataFrame:
    """Bitmap, size and least shingle of each class."""

    def run(batches):
        for b in batches:
            h, borders = ragged(b.column(1))
            h = h.view(np.uint64)
            n = np.diff(borders)
            some = n > 0
            at = borders[:-1][some]
            cols = []
            for w in range(WORDS):
                bit = np.where(h >> np.uint64(62) == np.uint64(w), _ONE << (h >> np.uint64(20) & np.uint64(63)), np.uint64(0))
                out = np.zeros(b.num_rows, dtype=np.uint64)
                if len(h):
                    out[some] = np.bitwise_or.reduceat(bit, at)
                cols.append(pa.array(out.view(np.int64)))
            least = np.zeros(b.num_rows, dtype=np.uint64)
            if len(h):
                least[some] = np.minimum.reduceat(mix(h), at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), pa.array(least.view(np.int64)), *cols], names=["k", "n", "least", *(f"s{w}" for w in range(WORDS))])

    return sets.select("k", "sh").mapInArrow(run, "k bigint, n int, least bigint, " + ", ".join(f"s{w} bigint" for w in range(WORDS)))


def _need(small_a: np.ndarray, small_b: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of two sets of at least these sizes."""
    return np.ceil(threshold / (1 + threshold) * (small_a + small_b) - 1e-9)


class Tree:
    """Levels of nodes, leaves first; a node is the OR of its members' bitmaps, the greatest number
    of tokens by which a size exceeds its bitmap, and the range of sizes."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, least: np.ndarray) -> None:
        self.order = np.argsort(least, kind="stable")
        bits, size = bits[self.order], size[self.order]
        over = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, over, size, size)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            b, o, lo, hi = self.levels[-1]
            at = np.arange(0, len(o), step)
            self.levels.append((np.bitwise_or.reduceat(b, at, 0), np.maximum.reduceat(o, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
            step = FANOUT

    def width(self, level: int) -> int:
        return LEAF if level == 1 else FANOUT


def dual(a: Tree, b: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a and b that may reach the threshold; of one tree, each pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x = y = np.zeros(1, dtype=np.int64)
    while True:
        ba, oa, na, xa = (v[x] for v in a.levels[la])
        bb, ob, nb, xb = (v[y] for v in b.levels[lb])
        most = np.bitwise_count(ba & bb).sum(1) + np.minimum(oa, ob)
        good = (most >= _need(na, nb, threshold)) & (xa >= threshold * nb - 1e-9) & (xb >= threshold * na - 1e-9)
        if same:
            good &= (x < y) if la == lb == 0 else (x <= y)
        x, y = x[good], y[good]
        if la == lb == 0:
            return a.order[x], b.order[y]
        deep_a, deep_b = la >= lb, lb >= la
        if deep_a:
            la -= 1
            x, y = _open(x, y, a.width(la + 1), len(a.levels[la][1]))
        if deep_b:
            lb -= 1
            y, x = _open(y, x, b.width(lb + 1), len(b.levels[lb][1]))


def _open(x: np.ndarray, y: np.ndarray, width: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each x, with its y."""
    n = np.minimum(width, below - x * width)
    return np.repeat(x * width, n) + within(n), np.repeat(y, n)


def _list_pairs(bits, size, least, side, borders, threshold):
    """Row pairs of all posting lists, whose borders are given."""
    n = np.diff(borders)
    small = n <= LEAF
    lone = side[borders[:-1]] == 0
    # lists of one leaf: the leaf's members against each other, all lists at a time
    rows = np.flatnonzero(np.repeat(small & lone, n))
    after = np.repeat(borders[1:], n)[rows] - rows - 1
    x = np.repeat(rows, after)
    y = x + 1 + within(after)
    most = np.bitwise_count(bits[x] & bits[y]).sum(1)
    over = size - np.bitwise_count(bits).sum(1).astype(np.int64)
    good = most + np.minimum(over[x], over[y]) >= _need(size[x], size[y], threshold)
    good &= (size[x] >= threshold * size[y] - 1e-9) & (size[y] >= threshold * size[x] - 1e-9)
    out = [(x[good], y[good])]
    for i in np.flatnonzero(~(small & lone)):
        at = np.arange(borders[i], borders[i + 1])
        parts = [at[side[at] == k] for k in (0, 1, 2)]
        if len(parts[0]):
            t = Tree(bits[parts[0]], size[parts[0]], least[parts[0]])
            p, q = dual(t, t, threshold, True)
            out.append((parts[0][p], parts[0][q]))
        elif len(parts[1]) and len(parts[2]):
            t, u = (Tree(bits[p], size[p], least[p]) for p in parts[1:])
            p, q = dual(t, u, threshold, False)
            out.append((parts[1][p], parts[2][q]))
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def class_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` of different classes with a similarity of ``threshold`` or more, and ``sim``.

    ``sets`` has ``cls``, ``k``, ``n``, ``sh``, one row per class, and is read several times.
    """
    sets = sets.where(F.col("n") > 0)
    counts = bucket_counts(sets)
    posted = _postings(sets, counts, threshold)
    posted = (dealt(posted, BLOCK) if counts.max(initial=0) > BLOCK else posted.select("h", F.lit(0).cast("bigint").alias("pair"), F.lit(0).cast("tinyint").alias("side"), "k")).repartition("h", "pair").sortWithinPartitions("h", "pair")

    def shared(batches):
        for t, borders in lists_of(batches):
            n = np.diff(borders)
            yield from t.filter(pa.array(np.repeat(n > 1, n))).to_batches()

    def lists_of(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            h, p = held["h"].to_numpy(), held["pair"].to_numpy()
            new = np.flatnonzero((h[1:] != h[:-1]) | (p[1:] != p[:-1])) + 1
            if len(new):
                yield held.slice(0, int(new[-1])), np.concatenate([[0], new])
                held = held.slice(int(new[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield held, np.array([0, held.num_rows])

    def run(batches):
        for t, borders in lists_of(batches):
            yield from pairs(t, borders)

    def pairs(t, borders):
        bits = np.stack([t[f"s{w}"].to_numpy().view(np.uint64) for w in range(WORDS)], 1)
        x, y = _list_pairs(bits, t["n"].to_numpy().astype(np.int64), t["least"].to_numpy(), t["side"].to_numpy(), borders, threshold)
        k = t["k"].to_numpy()
        for i in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[v[i : i + 100_000]]) for v in (x, y)], names=["a", "b"])

    lists = posted.mapInArrow(shared, posted.schema).join(_signatures(sets), "k").repartition("h", "pair").sortWithinPartitions("h", "pair")
    found = lists.mapInArrow(run, "a bigint, b bigint")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    found = cut(found)
    # two classes may share 8 of their bytes: then both are verified
    ids = found.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    named = might_contain(bloom_of(ids, "k", max(1000, 2 * found.count())), F.col("k"), sets.sparkSession)
    kept = sets.select("k", "cls", "sh").where(named).join(ids, "k", "left_semi")
    left, right = (kept.select(F.col("k").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("sh").alias(f"sh_{x}")) for x in ("a", "b"))
    both = found.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sh_a", "sh_b"))
    sim = common / (F.size("sh_a") + F.size("sh_b") - common)
    return both.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), sim.alias("sim")).where(F.col("sim") >= threshold - 1e-12)


def near_duplicates(df: DataFrame, key: str, text: str = "text", width: int = 3, threshold: float = 0.6, least_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """Similar classes, and the membership of the rows in classes.

    Returns pairs (``a``, ``b``, ``sim``) between different classes and members (``key``, ``cls``).

    Defined cases: rows with a null key or text, or fewer than ``least_chars`` characters, take no
    part; a row repeated in full counts once; texts of fewer than ``width`` words are one shingle;
    texts without words are alike if both have none; an empty table gives no pairs.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) >= least_chars)).select(key, text)
    sets = shingle_sets(rows, key, text, width)
    # the sets are written once, one a class; members are read off the texts again, which is cheaper
    members = sets.select(key, "cls").distinct()
    classes = cut(sets.select("cls", "k", "n", "sh").dropDuplicates(["cls"]))
    return class_pairs(classes, threshold), members


def groups(pairs: DataFrame, members: DataFrame, key: str, alone: bool = False) -> DataFrame:
    """One row per member of a group: ``key``, ``group_id``, ``copies`` (rows of its class) and
    ``links`` (similar rows, its own copies included). If ``alone``, a member without a link is a group
    of its own, with its class as ``group_id`` and 0 links; otherwise it has no row.

    Groups are connected components of the classes, found by passing least labels along links and
    along labels until nothing changes; each round is written to the checkpoint folder.
    """
    links = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("label")))
    while True:
        near = links.join(label.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        step = label.join(near, "cls").select("cls", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("cls").alias("next"), F.col("next").alias("far"))
        new = cut(step.join(jump, "next", "left").select("cls", F.least("next", F.coalesce("far", "next")).alias("new"), "label"))
        label = new.select("cls", F.col("new").alias("label"))
        if new.where(F.col("new") != F.col("label")).isEmpty():
            break
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    reach = links.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("beside"))
    state = sizes.join(label, "cls", "left").join(reach, "cls", "left").where(F.lit(alone) | F.col("label").isNotNull() | (F.col("copies") > 1))
    state = state.select("cls", F.lower(F.hex(F.coalesce("label", "cls"))).alias("group_id"), "copies", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    return members.join(state, "cls").select(key, "group_id", "copies", "links")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("segment_id", "text")


def written_out(pairs: DataFrame, members: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """All pairs of rows, ``x`` and ``y`` with x < y, whose classes are linked or the same.

    A class of many members is dealt into parts of about ``hot``; each pair of parts is joined apart, so
    no task has all members of a class against all.
    """
    sizes = members.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").select("cls", F.ceil(F.col("c") / hot).alias("parts"))
    sizes = cut(sizes)
    part = F.pmod(F.xxhash64(key), F.col("parts")).alias("part")
    all_parts = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    wide = sizes.where("parts > 1")
    some = not wide.isEmpty()
    dealt_ = members.join(wide, "cls", "left").select("cls", key, F.coalesce(part, F.lit(0).cast("bigint")).alias("part")) if some else members.select("cls", key, F.lit(0).cast("bigint").alias("part"))
    links = pairs.select("a", "b")
    for side in ("a", "b"):
        if some:
            links = links.join(wide.withColumnRenamed("cls", side), side, "left").withColumn(f"part_{side}", F.explode(F.coalesce(all_parts, F.array(F.lit(0).cast("bigint"))))).drop("parts")
        else:
            links = links.withColumn(f"part_{side}", F.lit(0).cast("bigint"))
    left, right = (dealt_.select(F.col("cls").alias(x), F.col("part").alias(f"part_{x}"), F.col(key).alias(y)) for x, y in (("a", "x"), ("b", "y")))
    across = links.join(left, ["a", "part_a"]).join(right, ["b", "part_b"]).select("x", "y")
    copies = members.join(sizes, "cls").select("cls", key, part, F.explode(all_parts).alias("other"))
    first = copies.select("cls", F.col("part").alias("p"), F.col("other").alias("q"), F.col(key).alias("x"))
    second = copies.select("cls", F.col("other").alias("p"), F.col("part").alias("q"), F.col(key).alias("y"))
    same = first.join(second, ["cls", "p", "q"]).where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(same)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_duplicates(_segments(spark, d), "segment_id", least_chars=200)
    return written_out(pairs, cut(members), "segment_id").select(F.col("x").alias("segment_id_a"), F.col("y").alias("segment_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """All segments, one row each, by five-word shingles and a similarity of 0.8."""
    pairs, members = near_duplicates(_segments(spark, d).where(F.trim("text") != ""), "segment_id", width=5, threshold=0.8)
    return groups(pairs, cut(members), "segment_id", alone=True)


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL = {
    "p7_found": r"""
WITH s AS (SELECT DISTINCT segment_id, text FROM segments WHERE length(text) >= 200),
w AS (SELECT segment_id, list_filter(regexp_split_to_array(lower(text), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}\x{1c}-\x{1f}]+'), lambda x: x <> '') AS w FROM s),
g AS (SELECT segment_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2])) ELSE [array_to_string(w, ' ')] END) AS g FROM w),
e AS (SELECT segment_id, len(g) AS n, unnest(g) AS g FROM g),
p AS (SELECT a.segment_id AS a, b.segment_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.segment_id < b.segment_id GROUP BY 1, 2)
SELECT a AS segment_id_a, b AS segment_id_b FROM p WHERE c >= 0.6 * (na + nb - c) - 1e-9""",
}
