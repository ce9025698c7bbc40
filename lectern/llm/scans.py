"""Scanned pages: defects found and pages repaired into running paragraphs.

Words are grouped by the skeleton of their confusable glyphs. The frequent form of a group, by counts
over all text that is no scan, replaces the forms that do not stand on their own. Where a group has several
frequent forms, the word before decides: the form that most often follows it in text that is no scan is
taken, and only where none ever does the most frequent one; a word that stands on its own, but never after
the word before, gives way to one that does. Title lines are found by the skeleton of their letters with
digits masked, counted over the pages of a document. Lines are then reflowed with SQL windows.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.orphans import bloom_of, might_contain
from ..session import cut, table
from .text import batch, blank

#: Glyphs that scanning takes for one another, each with the one that stands for both.
SINGLE_FROM = "f1l|0cb5q6éèزجخيتشذضنлн"
SINGLE_TO = "tiiioehsgeeeرححبنسدصنпи"
SEVERAL = (("rn", "m"), ("ri", "n"), ("ei", "d"), ("vv", "w"), ("ii", "u"))
#: Words for "page" and "of" before and between numbers.
PAGE_WORDS = set("blad folio fol hoja foglio folha лист ورق 第 頁 页 หน้า पृष्ठ page pages seite pagina página pág pag p s blz bl стр страница с صفحہ صفحة ص pg".split())
#: A form stands on its own from so many occurrences and this share of its group's most frequent one.
LEAST_COUNT, LEAST_SHARE = 3, 0.002
FREQUENT = 5
PAGES_OF_TITLE = 3
#: From so many times that a form follows the word before, it replaces a word that never does.
LEAST_PAIRS = 5

_TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*")
_HAS_DIGIT = regex.compile(r"\d")
_CODE = regex.compile(r"[A-Za-z]{0,2}\d+|\d+[a-z]{0,2}")
_JUNK = regex.compile(r"(?<=\p{L})[|·^~'’`.,:;_*¬](?=\p{Ll})")
_STRAY = regex.compile(r"(?<=\p{L})[·^~|]|[·^~|](?=\p{L})")
_GLYPHS_IN_NUMBER = regex.compile(r"\d[OolI](?=[\d/.,\s]|$)|(?<![\p{L}\d])[OolI]\d+[/.]\d|(?<=[A-Z]{2}-)\d*[OolI]\d*")
_BREAK = regex.compile(r"([\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*)([-‐‑¬­·])[ \t]*$")
_NEXT = regex.compile(r"[\p{L}\p{M}\p{N}]*[\p{L}\p{M}]")
_ROMAN = "(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
_NUMBER = regex.compile(rf"[-–—\[(]*\s*(?:(?P<word>[\p{{L}}\p{{M}}\d]{{1,9}})\.?\s+)?(?P<n>\d{{1,4}}|{_ROMAN})(?:\s*/\s*\d{{1,4}}|\s+(?:of|von|de|di|van|sur|из|von)\s+\d{{1,4}}|\s*\(\s*\d{{1,4}}\s*\))?\s*[-–—\])]*")
_BESIDE = regex.compile(r"^(?P<a>.*?\S)\s{3,}(?P<b>\S.*)$")


def skeleton(word: str) -> str:
    """What a word looks like; equal for words that scanning takes for one another."""
    w = word.translate(_MAP)
    for a, b in SEVERAL:
        w = w.replace(a, b)
    return w


_MAP = str.maketrans(SINGLE_FROM, SINGLE_TO)
_PAGE_LOOKS = {skeleton(w) for w in PAGE_WORDS}


def _skeleton(c: Column) -> Column:
    c = F.translate(c, SINGLE_FROM, SINGLE_TO)
    for a, b in SEVERAL:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_number(part: str) -> bool:
    """Whether a line, or what stands beside a title, is the number of a page."""
    part = part.strip()
    m = _NUMBER.fullmatch(part)
    if not m:
        return False
    word, n = m["word"], m["n"]
    if word and not (word.lower() in PAGE_WORDS or skeleton(word.lower()) in _PAGE_LOOKS):
        return False
    return bool(word) or not n.isdigit() or len(n) <= 3 or part != n


def parts_of(line: str) -> tuple[str, bool]:
    """A line without a page number beside it, and whether there was one."""
    m = _BESIDE.match(line.strip())
    if m:
        if is_number(m["b"]):
            return m["a"], True
        if is_number(m["a"]):
            return m["b"], True
    return line, False


def title_key(line: str) -> str | None:
    """The skeleton of a title line's letters; None if the line looks like running text."""
    t = line.strip()
    if not t or t[-1] in ".!?؟۔…,;:":
        return None
    words = [w for w in _WORDS.findall(unicodedata.normalize("NFKC", t).lower()) if not _HAS_DIGIT.search(w) or len(_HAS_DIGIT.findall(w)) * 2 < len(w) and len(w) > 3]
    key = skeleton("".join(words).replace("'", "").replace("’", ""))
    return key if len(key) >= 4 else None


class Page:
    """A page's lines, with what can be told without looking at other pages."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        filled = [i for i, x in enumerate(self.lines) if x.strip()]
        #: From either end on: lines that may be titles or numbers, up to the first that can be neither.
        self.edges: list[list[int]] = []
        self.numbers: set[int] = set()
        self.beside: dict[int, str] = {}
        self.titles: dict[int, str] = {}
        self.loose: set[int] = set()
        for side in (filled, filled[::-1]):
            edge: list[int] = []
            for i in side:
                if is_number(self.lines[i]) and len(filled) > 1:
                    # outermost it is the page's number; behind titles only if these are shared
                    (self.loose if any(j in self.titles for j in edge) else self.numbers).add(i)
                    edge.append(i)
                    continue
                rest, had = parts_of(self.lines[i])
                key = title_key(rest)
                if had and not any(j not in self.numbers for j in edge):
                    self.beside[i] = rest
                if not key:
                    break
                self.titles[i] = key
                edge.append(i)
            self.edges.append(edge)
        self.body = [(i, self.beside.get(i, x)) for i, x in enumerate(self.lines) if i not in self.numbers]

    def breaks(self):
        """Words broken over two lines: line, left part, mark, right part."""
        for (i, a), (j, b) in zip(self.body, self.body[1:]):
            m = _BREAK.search(a)
            if not m or j != i + 1:
                continue
            n = _NEXT.match(b)
            if n and (n[0][0].islower() or not n[0][0].isupper() or m[1].isupper() and len(m[1]) > 2):
                yield i, m[1], m[2], n[0]

    def asked(self) -> dict[str, set[str]]:
        """All strings whose standing among the words decides about this page; words with the words
        before them."""
        out: dict[str, set[str]] = {}
        broken = {i for i, *_ in self.breaks()}
        before = ""
        for i, line in self.body:
            words = list(_WORDS.finditer(line))
            for w in words:
                x = w[0].lower()
                if x.isalpha() or not _CODE.fullmatch(x):
                    befores = out.setdefault(x, set())
                    if before:
                        befores.add(before)
                    if "'" in x or "’" in x:
                        out.setdefault("+" + x.replace("'", "").replace("’", ""), set())
                before = x
            for a, b in zip(words, words[1:]):
                if line[a.end() : b.start()] == " " and not _HAS_DIGIT.search(a[0] + b[0]):
                    out.setdefault("+" + (a[0] + b[0]).lower(), set())
            for m in _JUNK.finditer(line):
                left, right = regex.search(r"[\p{L}\p{M}\d]+$", line[: m.start()]), regex.match(r"[\p{L}\p{M}\d]+", line[m.end() :])
                if left and right:
                    out.setdefault("+" + (left[0] + right[0]).lower(), set())
            if i in broken:
                before = ""
        for _, left, _, right in self.breaks():
            for q in ("+" + (left + right).lower(), "+" + f"{left}-{right}".lower(), "+" + right.lower()):
                out.setdefault(q, set())
        return out


def lexicon(rows: DataFrame) -> DataFrame:
    """Words by count over text that is no scan: ``w``, ``n``, ``known``, ``best`` and ``most`` (the
    most frequent form with its skeleton and that form's count). Compounds with a hyphen also count
    where they stand in one line of a scan."""
    words = rows.select("scan", F.explode(_tokens()).alias("w")).groupBy("w").agg(F.count_if(~F.col("scan")).alias("n"), F.count_if("scan").alias("scanned"))
    words = cut(words)
    compound = words.where(F.col("w").contains("-"))
    parts = compound.select(F.explode(F.split("w", "-")).alias("w"), "n")
    whole = words.select("w", F.when(F.col("w").contains("-"), F.col("n") + F.col("scanned")).otherwise(F.col("n")).alias("n"))
    counted = whole.unionByName(parts).where(~F.col("w").rlike(r"\d")).groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    looks = counted.withColumn("look", _skeleton(F.col("w")))
    best = looks.groupBy("look").agg(F.max_by("w", F.struct("n", "w")).alias("best"), F.max("n").alias("most"), F.count_if(F.col("n") >= FREQUENT).alias("forms"))
    return looks.join(best, "look").select("w", "n", "look", "best", "most", "forms", (F.col("n") >= LEAST_SHARE * F.col("most")).alias("known"))


def _tokens() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))


def _by_context(asked: DataFrame, words: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdicts that hang on the word before: ``q`` (the word before, a tab, the word), ``state``, ``best``.

    Only pairs that stand on a page and whose second word has several frequent forms are counted over
    the text that is no scan; a Bloom filter of theirs keeps all others from being exchanged.
    """
    forms = words.where((F.col("forms") > 1) & (F.col("n") >= FREQUENT) & F.col("known")).select("look", F.col("w").alias("form"), F.col("n").alias("form_n"))
    here = asked.where("befores is not null").select("q", F.explode("befores").alias("before")).distinct().withColumn("look", _skeleton(F.col("q")))
    here = cut(here.join(forms, "look").withColumn("pair", F.concat_ws("\t", "before", "form")))
    pairs = here.select("pair").distinct()
    many = pairs.count()
    if not many:
        return here.select("q", F.lit("fix").alias("state"), F.col("form").alias("best")).limit(0)
    all_pairs = rows.where(~F.col("scan")).select(_tokens().alias("t")).where(F.size("t") > 1).select(F.explode(F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.concat_ws("\t", a, b))).alias("pair"))
    seen = all_pairs.where(might_contain(bloom_of(pairs, "pair", many), F.col("pair"), rows.sparkSession)).groupBy("pair").agg(F.count("*").alias("c"))
    told = here.join(seen, "pair", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    told = told.groupBy("before", "q").agg(F.max(F.struct("c", "form_n", "form")).alias("x"), F.max(F.when(F.col("form") == F.col("q"), F.col("c"))).alias("own"))
    unknown = F.col("own").isNull() & (F.col("x.c") > 0)
    strange = (F.col("own") == 0) & (F.col("x.c") >= LEAST_PAIRS)
    return told.where((unknown | strange) & (F.col("x.form") != F.col("q"))).select(F.concat_ws("\t", "before", "q").alias("q"), F.lit("fix").alias("state"), F.col("x.form").alias("best"))


def _verdicts(asked: DataFrame, words: DataFrame) -> DataFrame:
    """``q`` with ``state``: ``ok`` for a joined form that is a word, ``fix`` with ``best`` for a form
    that looks like a frequent word, ``unk`` for any other that is none."""
    q = asked.select("q").distinct().withColumn("joined", F.col("q").startswith("+")).withColumn("w", F.regexp_replace("q", r"^\+", "")).withColumn("look", _skeleton(F.col("w")))
    best = words.groupBy("look").agg(F.first("best").alias("best"), F.first("most").alias("most"))
    known = words.where("known").select("w", F.lit(True).alias("known"))
    told = q.join(known, "w", "left").join(best, "look", "left")
    fits = (F.col("most") >= FREQUENT) & (F.col("best") != F.col("w"))
    state = F.when(F.col("known") & F.col("joined"), "ok").when(F.col("known"), None).when(F.coalesce(fits, F.lit(False)), F.when(F.col("joined"), "like").otherwise("fix")).when(~F.col("joined"), "unk")
    return told.select("q", state.alias("state"), "best").where("state is not null")


class Reader:
    """Decides about one page, given the verdicts on what it asked and the titles it shares."""

    def __init__(self, page: Page, told: dict[str, tuple[str, str | None]], shared: set[str]) -> None:
        self.page, self.told = page, told
        self.paired = any("\t" in q for q in told)
        self.headers, self.numbers = set(), set(page.numbers)
        for edge in page.edges:
            for i in edge:
                if page.titles.get(i) in shared:
                    self.headers.add(i)
                elif i in page.loose:
                    self.numbers.add(i)
                elif i not in page.numbers:
                    break
        self.hyphens = {i: (a, m, b) for i, a, m, b in page.breaks() if self._split(a, m, b)}

    def _ok(self, joined: str) -> bool:
        return self.told.get("+" + joined, ("", None))[0] == "ok"

    def _split(self, left: str, mark: str, right: str) -> bool:
        if mark != "-":
            return True
        whole, own = (left + right).lower(), f"{left}-{right}".lower()
        if self._ok(own) and not self._ok(whole):
            return False
        return True

    def fix(self, line: str, skip_first: bool, skip_last: bool, before: str = "") -> tuple[str, bool]:
        """The line with misread words put right, and whether any was wrong; ``before`` is the last word of
        the line before."""
        wrong = bool(_STRAY.search(line)) or bool(_GLYPHS_IN_NUMBER.search(line))
        line = _STRAY.sub("", line) if wrong else line

        def mark(m):
            left, right = regex.search(r"[\p{L}\p{M}\d]+$", line[: m.start()]), regex.match(r"[\p{L}\p{M}\d]+", line[m.end() :])
            joined = (left[0] + right[0]).lower()
            apart = self.told.get((left[0] + m[0] + right[0]).lower(), ("", None))[0] if m[0] in "'’" else "unk"
            return self._ok(joined) and apart in ("unk", "fix") and (m[0] not in ".,:;" or "unk" in (self.told.get(left[0].lower(), ("", 0))[0], self.told.get(right[0].lower(), ("", 0))[0]) or "fix" in (self.told.get(left[0].lower(), ("", 0))[0], self.told.get(right[0].lower(), ("", 0))[0]))

        out = _JUNK.sub(lambda m: "" if mark(m) else m[0], line)
        wrong |= out != line
        words = list(_WORDS.finditer(out))
        small = [w[0].lower() for w in words]
        # where no word has a verdict, there is nothing to put right
        if self.told.keys().isdisjoint(small) and (not self.paired or self.told.keys().isdisjoint(map("\t".join, zip([before, *small], small)))):
            return out, wrong
        text, at, i = "", 0, 0
        while i < len(words):
            w = words[i]
            text += out[at : w.start()]
            at = w.end()
            state, best = self.told.get(f"{before}\t{w[0].lower()}") or self.told.get(w[0].lower(), ("", None))
            before = w[0].lower()
            piece = w[0]
            edge = (i == 0 and skip_first) or (i == len(words) - 1 and skip_last)
            if i + 1 < len(words) and out[w.end() : words[i + 1].start()] == " " and not edge and not (i + 1 == len(words) - 1 and skip_last):
                other = words[i + 1][0]
                if self._ok((w[0] + other).lower()) and (state in ("unk", "fix") or self.told.get(other.lower(), ("", None))[0] in ("unk", "fix")) and (other[0].islower() or not other[0].isupper() or other.isupper()):
                    text += w[0] + other
                    at = words[i + 1].end()
                    before = other.lower()
                    wrong = True
                    i += 2
                    continue
            if state == "fix" and not edge:
                wrong = True
                piece = best.upper() if piece.isupper() and len(piece) > 1 else best[:1].upper() + best[1:] if piece[0].isupper() else best
            text += piece
            i += 1
        return text + out[at:], wrong

    def read(self) -> tuple[set[str], list[tuple[str, bool]]]:
        """The defects, and the repaired lines with whether the next line goes on within a word."""
        found: set[str] = set()
        if self.numbers or self.page.beside:
            found.add("page_number")
        if self.headers:
            found.add("header")
        if self.hyphens:
            found.add("hyphenation")
        lines, after, before = [], False, ""
        for i, line in self.page.body:
            if i in self.numbers:
                continue
            broken = i in self.hyphens
            if broken:
                left, mark_, right = self.hyphens[i]
                if self.told.get("+" + (left + right).lower(), ("", None))[0] == "like" and not regex.fullmatch(r"[\p{Lu}]+.*", left):
                    found.add("misread")
                line = regex.sub(r"[-‐‑¬­·][ \t]*$", "", line)
            fixed, wrong = self.fix(line, after, broken, before)
            after = broken
            if words := _WORDS.findall(line):
                before = "" if broken else words[-1].lower()
            if wrong:
                found.add("misread")
            if i not in self.headers:
                lines.append((fixed.strip(), broken))
        return found, lines


def read_scans(df: DataFrame, key: str, text: str, path: str, scan: str) -> DataFrame:
    """Scanned pages, repaired: ``key``, ``defects`` (sorted) and ``lines`` (array of line and glue).

    ``df`` holds all texts; ``scan`` says which are pages. Defined cases: null and blank pages have
    no row; a page repeated in full counts once; a page without a path shares its titles with no
    other; with no text beside scans, no word is known and nothing is called misread but stray signs;
    pages of any length are read whole.
    """
    rows = df.where(F.col(key).isNotNull() & ~blank(F.col(text))).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(path).alias("path"), F.coalesce(F.col(scan), F.lit(False)).alias("scan"))
    pages = rows.where("scan").select("key", "text", "path").distinct()

    def ask(batches):
        for b in batches:
            out = {"key": [], "path": [], "q": [], "befores": [], "title": []}
            for k, t, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                page = Page(t)
                for q, befores in page.asked().items():
                    for name, v in zip(out, (k, p, q, sorted(befores) or None, None)):
                        out[name].append(v)
                for title in set(page.titles.values()):
                    for name, v in zip(out, (k, p, None, None, title)):
                        out[name].append(v)
            yield batch(out, befores=pa.list_(pa.string()))

    asked = cut(pages.mapInArrow(ask, "key string, path string, q string, befores array<string>, title string"))
    queries = asked.where("q is not null").select("key", "q", "befores")
    words = cut(lexicon(rows))
    told = cut(_verdicts(queries, words).unionByName(_by_context(queries, words, rows)))
    all_queries = queries.select("key", "q").unionByName(queries.select("key", "q", F.explode("befores").alias("b")).select("key", F.concat_ws("\t", "b", "q").alias("q")))
    few = all_queries.where(might_contain(bloom_of(told, "q", max(1000, told.count())), F.col("q"), df.sparkSession)).join(told, "q")
    told_of = few.groupBy("key").agg(F.collect_list(F.struct("q", "state", "best")).alias("told"))
    titles = asked.where("title is not null and path is not null").select("key", "path", "title")
    shared = titles.groupBy("path", "title").agg(F.countDistinct("key").alias("pages")).where(F.col("pages") >= PAGES_OF_TITLE).select("path", "title")
    shared_of = titles.join(shared, ["path", "title"]).groupBy("key").agg(F.collect_set("title").alias("shared"))
    joined = pages.select("key", "text").join(told_of, "key", "left").join(shared_of, "key", "left")

    def decide(batches):
        lines_type = pa.list_(pa.struct([("line", pa.string()), ("glue", pa.bool_())]))
        for b in batches:
            out = {"key": [], "defects": [], "lines": []}
            for k, t, told, shared in zip(*(b.column(i).to_pylist() for i in range(4))):
                reader = Reader(Page(t), {x["q"]: (x["state"], x["best"]) for x in told or ()}, set(shared or ()))
                found, lines = reader.read()
                out["key"].append(k)
                out["defects"].append(sorted(found))
                out["lines"].append([{"line": x, "glue": g} for x, g in lines])
            yield batch(out, defects=pa.list_(pa.string()), lines=lines_type)

    return joined.mapInArrow(decide, "key string, defects array<string>, lines array<struct<line:string,glue:boolean>>").withColumnRenamed("key", key)


def reflow(scans: DataFrame, key: str) -> DataFrame:
    """Running paragraphs of repaired lines: ``key``, ``paragraph_no`` (from 1), ``text``.

    A paragraph ends at an empty line, and after a line that ends a sentence well short of the
    page's longest line.
    """
    lines = scans.select(key, F.posexplode("lines").alias("pos", "x")).select(key, "pos", F.col("x.line").alias("line"), F.col("x.glue").alias("glue"))
    page, before = W.partitionBy(key), W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("wide", F.max(F.length("line")).over(page)).withColumn("last", F.lag("line").over(before))
    ends = F.col("last").rlike("[.!?…؟۔।]['\"”»“’)]*$") & (F.length("last") < 0.75 * F.col("wide"))
    lines = lines.withColumn("starts", (F.col("last").isNull() | (F.col("last") == "") | ends).cast("int"))
    lines = lines.withColumn("paragraph", F.sum("starts").over(before)).where(F.col("line") != "")
    lines = lines.withColumn("paragraph_no", F.dense_rank().over(W.partitionBy(key).orderBy("paragraph")))
    parts = lines.groupBy(key, "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "glue"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["line"], F.when(p["glue"], "").otherwise(" "))), "")
    return parts.select(key, "paragraph_no", F.trim(joined).alias("text"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").select("segment_id", "text", "normalized_path", "kind", "locator_json")
    scan = F.col("kind").isin("image", "pdf") & (F.get_json_object("locator_json", "$.origin") == "ocr")
    return read_scans(rows.withColumn("scan", scan), "segment_id", "text", "normalized_path", "scan")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).select("segment_id", F.explode("defects").alias("defect")).distinct()


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return reflow(_scans(spark, d), "segment_id")


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}
