"""Sentence units of texts in many languages, each with its place in the text.

Spaced scripts: every end mark, and every line break, is a node of a lattice; a node's score weighs
what stands before it (abbreviations, initials, numbers) and after it (case, openers), the spans
between nodes are scored too (a span without letters is no sentence), marks inside paired quotes and
brackets are no nodes, and the best path through the lattice, found by dynamic programming over the sums
of both, gives the sentences.

Spaceless scripts: words are found on a lattice of dictionary words of whole runs; gaps (blanks, in Thai
line breaks too) are then classified by the particles and words that end the left side and the words that
open the right side. The dictionary has the particles and words of the lists below and all words that
the counts over the corpus show (``words``), with which of them open sentences.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .text import blank
from .words import Dictionary, word_counts

#: Abbreviations that a name, a number or a noun follows, and ones that may end a sentence.
LEADING = set("""
dr mr mrs ms prof st no nos nr núm num approx ca circa cf vgl cfr cp pp vs fig figs e.g i.e viz v vol ch sec art max min incl excl ref réf réfs dep dept gen gov sgt capt rev hon messrs mt
mme mmes mlle m mm me env chap éd fig n° nº az aktz rd bzw bzgl evtl ggf hr fr frl bl abs anl bspw inkl str tel sog usw.z dhr mevr mw bijv blz dir ing ir jhr art afb sr sra srta dra dna pág págs pag pagg ej cap exp núms sig sigg sig.ra dott dott.ssa avv prot es fasc tav proc dña exmo exma eng arq doc ok ок им см прил т рис стр гл ред тов проф напр др д.н
""".split())
ENDING = set("etc al ltd inc co corp a.m p.m am pm ph.d u.n u.s u.k seq r.h mio mrd tsd г гг руб коп p f ff jr sr. bd d.w.z z.b d.h u.a p.ej т.е т.д т.п д д.р ecc enz".split())
#: Words that no line of its own ends with.
JOINING = set("""
the a an of to in on at by for with from and or but as is was were be been that which who whose than into under over behind per this these her his their its not no before after until because although though while
le la les l un une des du de d à au aux en et ou par pour sur sous dans avec sans que qui dont est a ont été sa son ses ce cette n ne pas plus avant après selon
der die das den dem des ein eine einen einem einer eines und oder von vom zu zum zur mit ohne bei beim auf aus an am in im für gegen trotz nach vor unter über während durch als dass nicht hat ist wird wurde
el los las un una unos unas del al y o u con sin por para en ante bajo desde hasta según sobre tras que no ha fue se su sus lo
il lo gli i uno dello della dei degli delle dal dalla nel nella sul sulla con per tra fra di da su e o ed che non ha è sono prima dopo senza secondo
o os as um uma do da dos das no na nos nas ao à aos às pelo pela e ou com sem por para em que não foi se seu sua antes
de het een en of van voor met zonder op aan in uit bij naar door tot tijdens onder over dat die niet is was werd heeft
и в во на с со к ко от до из за по о об у при под над для без не что как
""".split())
#: Thai words that open a sentence, that open its subject, and that go on with it.
TH_OPEN = "นอกจากนี้ อย่างไรก็ตาม อย่างไรก็ดี ดังนั้น ต่อมา จากนั้น ทั้งนี้ ขณะเดียวกัน ในขณะเดียวกัน ในวันเดียวกัน วันเดียวกัน ในทางกลับกัน ตรงกันข้าม ในที่สุด เบื้องต้น ในเบื้องต้น สำหรับตอนนี้ ตามรายงาน ตามบันทึก ตามบันทึกการประชุม ก่อนอื่น ประการแรก สุดท้าย".split()
TH_SUBJECT = "คณะ คณะกรรมการ ฝ่าย แผนก ทีม สำนักงาน สำนัก หอ หอจดหมายเหตุ โรง ผู้ ผู้ตรวจ ผู้ดูแล ผู้รับเหมา ยาม เลขานุการ บริษัท กลุ่ม กรม กอง งาน หน่วย ศูนย์ สภา เจ้าหน้าที่ พนักงาน นาย นาง นางสาว ห้อง ช่าง ตัวแทน ผู้แทน สถาบัน องค์การ พิพิธภัณฑ์ ท่าเรือ ประธาน กรรมการ นัก เรา เขา พวกเขา ฉัน ผม ใคร".split()
TH_GO_ON = "เลขที่ เมื่อ เมื่อวันที่ ใน ก่อน หลัง หลังจาก โดย แม้ แม้ว่า เพราะ เพื่อ ที่ ซึ่ง อัน และ หรือ แต่ กับ จาก ของ ถึง สำหรับ ระหว่าง ตาม ล่าช้า ด้วย พร้อม ต่อ แก่ ให้ ว่า ไป มา แล้ว ราว ประมาณ หน้า แฟ้ม ฉบับ วันที่ เวลา ณ ภาย เนื่อง จน ทุก ครั้ง".split()
TH_MONTHS = "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split()
#: Particles that end a Thai clause; Japanese forms that end a sentence in any place, forms that end one or stand before a noun, words that open one, and ones that go on.
TH_FINAL = "ครับ ค่ะ คะ นะ จ้ะ ไหม หรือไม่ หรือเปล่า".split()
JA_FINAL = "です ます ません でした ました ましょう ですか ますか でしたか ましたか ませんでした である であった だった ください ですね ますね ですよ ますよ でしょう だろう".split()
JA_PLAIN = "た だ る う く す つ む ぬ ぶ ぐ ない か ね よ".split()
JA_OPEN = "しかし また そして その後 なお ただし 次に それから さらに 一方 そのため したがって だが ところが では つまり 例えば まず 最後に 同日 翌日 当日 私 彼 彼女 我々".split()
JA_GO_ON = "を は が に の と で も へ や から まで より など という って との ため".split()
JA_QUOTING = ("と", "って", "という", "との", "を", "は", "が", "に", "の", "、", "，")
#: Chinese particles that end a sentence, words that no clause ends with, words that open a sentence, and ones that go on with it.
ZH_FINAL = "了 吗 呢 吧 啊 呀 嗎".split()
ZH_JOINING = "和 与 與 及 或 的 在 从 從 对 對 为 為 把 被 将 將 由 给 給 向 是 以 并 並 因 于 於".split()
ZH_OPEN = "但是 但 因此 所以 此外 另外 然而 同时 同時 随后 隨後 之后 接着 最后 最後 首先 其次 然后 然後 我们 我們 他们 他們 他 她 这 這 该 該 本 由于 由於 为了 為了 根据 根據 如果 虽然 雖然 不过 不過 目前 当时 當時 次日 今天 昨天 明天".split()
ZH_GO_ON = "的 了 和 与 與 及 或 等 之 而 以及 并 並 地 得".split()
#: Characters on both sides of a blank from which Chinese clauses, with nothing else to tell, are two.
ZH_CLAUSE = 6

OPENERS, CLOSERS = "“‘«„‹「『（(【《〈[", "”’»“›」』）)】》〉]"
_PAIR = {"“": "”", "«": "»", "„": "“”", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "〈": "〉", "[": "]", "‘": "’"}
_MARK = re.compile(r"[.!?…؟۔।॥。！？｡]+")
_HARD = re.compile(r"[!?؟۔।॥。！？｡]")
_LINE = re.compile(r"[ \t\r　]*\n[\s]*")
_CLOSING = "”’»“›」』）)】》〉]\"'*_`"
_THAI = re.compile("[฀-๿]")
_EAST = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
_KANA = re.compile("[぀-ヿｦ-ﾟ]")
_EAST_RUN = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ々]+")
_EAST_GAP = re.compile(r"(?<=[぀-ヿ㐀-鿿ｦ-ﾟ々])[ \t　]+(?=[぀-ヿ㐀-鿿ｦ-ﾟ])")
_SOUND = re.compile(r"[^\W_]")
_CASELESS = re.compile("[؀-ۿऀ-ॿ]")
_WORD = re.compile(r"[^\W\d_]+(?:[.'’][^\W\d_]+)*", re.UNICODE)
_BULLET = re.compile(r"(?:[-*•–—▪◦>|#]+[ \t]|\d{1,3}[.)][ \t]+(?!(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)[^\W\d_]|[a-z]\)[ \t]|```|R-\d|\||\{)")
_CODE = re.compile(r"[\[(]?(?:[A-Z]{1,3}-\d+|[A-Z]?\d+[./]\d+|\d+)[\])]?$")
_NOISE = r"(?:[\[(](?:[A-Z]{1,3}-\d+|[A-Z]?\d+[./]\d+)[\])]|[A-Z]{1,3}-\d+|[A-Z]?\d+[./]\d+)"
_SKIP = re.compile(rf"[\s\"'“‘«„‹「『【《〈¿¡*_`—–-]*(?:{_NOISE}\s+)*[\s\"'“‘«„‹「『（(【《〈\[¿¡*_`—–-]*")
_DAY = re.compile(rf"\b(?:am|den|dem|der|vom|zum|bis|im|le|il|el|den)\s+(?:{_NOISE}\s+)*\d{{1,2}}$", re.IGNORECASE)
_GAP = re.compile(r"[ \t \n]+")
#: Beginnings farther back than this are compared by kind (``_kind``), as a line's score asks no more of them.
FAR = 400
_BREAK = re.compile(r"[ \t\n]")


def _straight(text: str, i: int) -> tuple[bool, bool]:
    """Whether the straight quotation mark at ``i`` may open and may close a quotation, by what it touches."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    outer, inner = not before or before.isspace() or before in _PAIR or before in "—–-/", not after or after.isspace() or not after.isalnum()
    return outer and bool(after) and not after.isspace(), not outer and inner or not after


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Spans between paired marks of one paragraph, ends exclusive of the closing mark; a mark without
    its partner pairs with nothing."""
    out = []
    stack: list[tuple[str, int]] = []
    for m in re.finditer("[“”‘’«»„‹›「」『』（）()【】《》〈〉\\[\\]\"]|\n\\s*\n", text):
        c, i = m[0], m.start()
        if c[0] == "\n":
            stack.clear()
            continue
        if c == '"':
            opens, closes = _straight(text, i)
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if k is not None and (closes or not opens):
                out.append((stack[k][1], i))
                del stack[k:]
            elif opens or not closes:
                stack.append((c, i))
            continue
        if c == "’" and 0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha():
            continue
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIR.get(stack[k][0], "")), None)
        if k is not None:
            out.append((stack[k][1], i))
            del stack[k:]
        elif c in _PAIR:
            stack.append((c, i))
    return out


_THAI_WORDS = frozenset([*TH_OPEN, *TH_SUBJECT, *TH_GO_ON, *TH_MONTHS, *TH_FINAL])
_JA_WORDS = frozenset([*JA_FINAL, *JA_PLAIN, *JA_OPEN, *JA_GO_ON])
_ZH_WORDS = frozenset([*ZH_FINAL, *ZH_JOINING, *ZH_OPEN, *ZH_GO_ON])
#: The dictionary without a corpus.
PLAIN = Dictionary()


def _first_word(words: Dictionary, given: frozenset[str], run: str) -> str:
    """The first word of a run."""
    return words.cut(run, given)[0] if run else ""


def _last_word(words: Dictionary, given: frozenset[str], run: str) -> str:
    return words.cut(run, given)[-1] if run else ""


def _east_gap(left: str, right: str, words: Dictionary = PLAIN) -> float:
    """How well a Chinese or Japanese sentence ends at a blank."""
    left, right = _EAST_RUN.findall(left)[-1:], _EAST_RUN.match(right)
    if not left or not right:
        return -5.0
    run, rest = left[0], right[0]
    if _KANA.search(run) or _KANA.search(rest):
        # only endings and openings are looked up: kanji between them are no words of the dictionary
        last = next((w for w in sorted([*JA_FINAL, *JA_PLAIN], key=len, reverse=True) if run.endswith(w)), "") if _last_word(words, _JA_WORDS, run) in _JA_WORDS else ""
        first = _first_word(words, _JA_WORDS, rest)
        if first in JA_GO_ON or not last:
            return -5.0 if first in JA_GO_ON else -3.0
        if last in JA_FINAL:
            return 4.0
        # a plain form may stand before a noun, unless what follows opens or is a sentence
        return 2.0 if first in JA_OPEN or words.opens(first) or rest.endswith((*JA_FINAL, *JA_PLAIN)) and min(len(run), len(rest)) > ZH_CLAUSE else -2.0
    last, first = _last_word(words, _ZH_WORDS, run), _first_word(words, _ZH_WORDS, rest)
    if first in ZH_GO_ON:
        return -5.0
    if last in ZH_JOINING:
        return -4.0
    if min(len(run), len(rest)) < ZH_CLAUSE // 2:
        return -2.0
    if last in ZH_FINAL or first in ZH_OPEN or words.opens(first):
        return 3.0
    return 1.0 if min(len(run), len(rest)) >= ZH_CLAUSE else -2.0


def _thai_gap(left: str, right: str, words: Dictionary = PLAIN) -> float:
    last = re.split(r"[ \n\t]", left.rstrip())[-1]
    if last in TH_OPEN or any(last.endswith(x) for x in TH_OPEN if len(x) > 5):
        return -5.0
    if not right or right[0] in "([（%,;:)]":
        return -5.0
    if re.match(r"\d|[A-Z]{1,3}-\d|[A-Z]\d", right):
        return -5.0
    head = re.match("[฀-๿]+", right)
    word = _first_word(words, _THAI_WORDS, head[0] if head else "")
    if word in TH_MONTHS:
        return -5.0
    if re.search(r"(?:เลขที่|วันที่|ดร\.|นาย|นาง|คุณ|แฟ้ม|ราว|หน้า)$", left.rstrip()):
        return -5.0
    if any(right.startswith(x) for x in TH_OPEN):
        return 4.0
    if word in TH_SUBJECT or word not in TH_GO_ON and words.opens(word):
        return 3.0
    ending = re.search("[฀-๿]+$", last)
    if ending and _last_word(words, _THAI_WORDS, ending[0]) in TH_FINAL:
        return 3.0
    if word in TH_GO_ON:
        return -3.0
    if right[0].isupper() and re.match(r"[A-Z][a-z]+", right):
        return 2.0
    chunk = re.match("[฀-๿]+", right)
    return 1.0 if chunk and len(chunk[0]) >= 12 else -2.0


def _before(text: str, at: int) -> str:
    """The word that ends at ``at``, with inner marks, in lower case."""
    m = re.search(r"[^\s()\[\]“”«»„\"'’‘/,;:]+$", text[max(0, at - 24) : at])
    word = m[0].lower() if m else ""
    head, _, tail = word.rpartition(".")
    # where the blank after an end mark is missing, the word begins behind that mark
    return tail if len(head.split(".")[-1]) > 2 and tail and word not in ENDING and word not in LEADING else word


def _mark_score(text: str, start: int, end: int, close: int) -> float:
    """How well a sentence ends with the marks at start..end, closing marks up to close included."""
    marks = text[start:end]
    rest = text[close : close + 100]
    here = _SKIP.match(text, close)
    nxt = text[here.end() : here.end() + 2] if here else rest[:2]
    spaced = close < len(text) and text[close].isspace()
    if close >= len(text):
        return 5.0
    if _HARD.search(marks):
        if any(c in "。！？｡" for c in marks) or (_EAST.search(text[max(0, start - 1) : start]) and marks[-1] in "!?"):
            after = rest.lstrip(" ")
            if close > end and after.startswith(JA_QUOTING):
                return -5.0
            return 4.0
        if any(c in "۔।॥" for c in marks):
            return -1.0 if close > end and rest.lstrip().startswith(("،", ",")) else 4.0
        if nxt[:1].islower():
            return -4.0
        if not spaced and not (nxt[:1].isupper() or _CASELESS.match(nxt) or _EAST.match(nxt) or nxt[:1] in "«“„"):
            return -3.0
        if re.match(r"\s*[,;:—–]", rest):
            return -4.0
        return 4.0
    word = _before(text, start)
    if marks in ("...", "…", "....") or len(marks) > 1:
        return 2.0 if (spaced or close > end) and (nxt[:1].isupper() or nxt[:1].isdigit() or _CASELESS.match(nxt)) else -3.0
    if re.match(r"\s*[,;:—–]", rest):
        return -4.0
    before = text[start - 1 : start]
    if not spaced:
        if close == end:
            # a missing blank: a lower-case end against a capital that begins a word
            tail = text[max(0, start - 2) : start]
            joined = (tail.islower() and tail.isalpha() and len(tail) == 2) or before in ")»”" or re.search(r"(?:\d{4}|\d[./]\d+)$", text[max(0, start - 12) : start]) or word in ENDING
            if joined and re.match(r"[\[(«“„¿¡\"]?[^\W\d_a-zà-ÿ]", text[close : close + 2]) and (re.match(r"[\[(«“„¿¡\"]*[A-ZÀ-ÞА-ЯЁ](?:[a-zà-ÿа-яё'’]|\s)", rest) or _CASELESS.match(rest) or _EAST.match(rest)):
                if _THAI.match(rest):
                    return -3.0
                return 3.0
            return -5.0
    if len(word) == 1 and word.isalpha() and (before.isupper() or _CASELESS.match(before)):
        return -4.0
    if word in LEADING or word.split(".")[-1] in LEADING and "." not in word and word in LEADING:
        return -4.0
    if nxt[:1].islower():
        return -4.0
    if word.isdigit() and len(word) <= 2 and _DAY.search(text[max(0, start - 60) : start]):
        return -4.0
    if word in ENDING and len(word) > 1 and text[start - 1].isupper() and nxt[:2].isupper():
        return -1.0
    if word in ENDING or re.fullmatch(r"(?:\w\.)+\w", word):
        return 1.5 if nxt[:1].isupper() or _CASELESS.match(nxt) or _EAST.match(nxt) else -3.0
    if _THAI.match(before) and not nxt[:1].isupper():
        return -3.0
    if _CASELESS.match(before) and len(word) <= 3 and not _CASELESS.match(nxt):
        return -3.0
    if re.fullmatch(r"\d{1,3}", word) and re.match(r"\s*(?:\n|$)", rest) is None and text[max(0, start - 4) : start].rstrip("0123456789").endswith("\n"):
        return -3.0
    return 3.0


def _coded_line(text: str, at: int) -> bool:
    """A short line that begins at ``at``, begins small and ends in a code: one of a list."""
    stop = text.find("\n", at)
    words = text[at : stop if stop >= 0 else len(text)].split()
    return 2 <= len(words) <= 8 and words[0][:1].islower() and bool(_CODE.fullmatch(words[-1])) and words[-1][0] not in "[("


def _line_score(text: str, unit: int, start: int, end: int, words_of: Dictionary = PLAIN) -> float:
    """How well a unit that began at ``unit`` ends with the line break at start..end."""
    if text.count("\n", start, end) > 1:
        return 6.0
    line = text[unit:start].strip()
    right = text[end : end + 60]
    if not line or not right:
        return 4.0
    if _BULLET.match(right) or _BULLET.match(line):
        return 4.0
    if line[-1] in ",;(-–—/&" or right[0] in ",;)":
        return -4.0
    tail = line.rstrip("".join(set(_CLOSING)))
    if tail and _MARK.match(tail[-1]):
        if _coded_line(text, end):
            return 3.0
        return 3.0 if _mark_score(text, start - 1, start, start) > 0 else -2.0
    words = line.split()
    last = words[-1].lower().strip("()[]\"'“”«»")
    if _THAI.search(line[-12:]) or _THAI.match(right):
        if _CODE.search(words[-1]) and len(words) <= 4:
            return 4.0
        return _thai_gap(line, right, words_of)
    first = right.lstrip("\"'“‘«„‹「『（(【《〈[¿¡*_`")[:1]
    coded = bool(_CODE.search(words[-1]))
    if _EAST.search(line) or _EAST.match(first):
        return 4.0 if coded and len(words) <= 4 else (-3.0 if _EAST.match(right) else 1.0)
    if _CASELESS.search(line[-30:]) or _CASELESS.match(first):
        return 4.0 if coded and len(words) <= 8 and not re.search(r"[\])]$", words[-1]) else -3.0
    if last in JOINING or last.rstrip(".") in LEADING:
        return -4.0
    if words[0][:1].islower():
        # a line of a list begins small where a sentence does not
        return 3.0 if coded or first.isupper() else -2.0
    if first.islower():
        return 2.0 if coded and len(words) <= 6 and _coded_line(text, end) and not re.search(r"[\])]$", words[-1]) else -4.0
    if first.isdigit():
        return 2.0 if len(words) <= 5 else -1.0
    return 3.0 if len(words) <= 8 else -1.5


def _chunk_before(text: str, end: int, least: int) -> int:
    """Where what stands before a gap begins: behind the blank before it."""
    return max(least, *(text.rfind(c, least, end) + 1 for c in " \t\n\u3000"))


def _chunk_after(text: str, start: int) -> int:
    """Where what stands behind a gap ends: at the next blank."""
    m = _BREAK.search(text, start)
    return m.start() if m else len(text)


def _kind(text: str, unit: int) -> tuple[bool, bool]:
    """What the score of a far line break takes from where its unit begins."""
    head = text[unit : unit + 12].lstrip()
    return bool(_BULLET.match(head)), head[:1].islower()


def _best_path(text: str, nodes: list[tuple[int, str, int, int, int]], words: Dictionary = PLAIN) -> list[int]:
    """The cuts of the path with the greatest sum of node and span scores.

    The score of a node may depend on where the span that it ends begins; there is a way from one to the
    other only if it is positive. A span without letters or digits
    pays for that, and a span that runs over a good end pays what that end was worth to it. Beginnings
    farther than ``FAR`` count by the best one of each kind.
    """
    places, values, backs, paid = [0], [0.0], [-1], [0.0]
    far: dict[tuple[bool, bool], int] = {}
    passed = 0

    def step(score, at: int, unit: int) -> float:
        value = score(unit)
        # a span without letters or digits is no sentence of its own
        return value - 10.0 if not _SOUND.search(text, unit, at) else value

    def arrive(at: int, score) -> tuple[float, int]:
        nonlocal passed
        while passed < len(places) and places[passed] < at - FAR:
            kind = _kind(text, places[passed])
            if kind not in far or values[passed] - paid[passed] >= values[far[kind]] - paid[far[kind]]:
                far[kind] = passed
            passed += 1
        found = (-1e9, -1)
        for k in [*far.values(), *range(passed, len(places))]:
            if places[k] < at:
                worth = step(score, at, places[k])
                if worth > 0 or at == len(text):
                    found = max(found, (values[k] - paid[k] + worth, k))
                    paid[k] += worth
        return found

    learned = () if words is PLAIN else (words,)
    for at, kind, start, end, close in nodes:
        if not 0 < at < len(text):
            continue
        if kind == "mark":
            fixed = _mark_score(text, start, end, close)
        elif kind == "east":
            fixed = _east_gap(text[_chunk_before(text, start, 0) : start], text[end : _chunk_after(text, end)], *learned)
        if kind == "line":
            score = lambda unit: _line_score(text, unit, start, end, *learned)  # noqa: B023, E731
        elif kind == "gap":
            right, begin = text[end : _chunk_after(text, end)], _chunk_before(text, start, 0)
            score = lambda unit: _thai_gap(text[max(unit, begin) : start], right, *learned) if _THAI.search(text, max(unit, start - 40), start) else -3.0  # noqa: B023, E731
        else:
            score = lambda unit: fixed  # noqa: B023, E731
        if kind in ("mark", "east") and fixed <= 0:
            continue
        value, back = arrive(at, score)
        if back < 0:
            continue
        if places[-1] == at:
            if value > values[-1]:
                values[-1], backs[-1] = value, back
        else:
            places.append(at)
            values.append(value)
            backs.append(back)
            paid.append(0.0)
    _, k = arrive(len(text), lambda unit: 0.0)
    cuts = []
    while k > 0:
        cuts.append(places[k])
        k = backs[k]
    return cuts[::-1]


def sentences(text: str | None, words: Dictionary = PLAIN) -> list[tuple[int, int]]:
    """Places of the sentences of a text, blanks at the ends left out; none for null and blank text.

    Each character that is no blank lies in exactly one of them.
    """
    if not text or text.isspace():
        return []
    inside = _enclosed(text)
    covered = bytearray(len(text) + 1)
    for a, b in inside:
        covered[a + 1 : b] = b"\1" * (b - a - 1)
    opens, closes = {a for a, _ in inside}, {b for _, b in inside}

    nodes: list[tuple[int, str, int, int, int]] = []
    for m in _MARK.finditer(text):
        close = m.end()
        while close < len(text) and text[close] in _CLOSING:
            # an opening mark of the same look begins the next sentence
            if text[close] in "\"'“" and close not in closes and close in opens:
                break
            close += 1
        if close < len(text) - 1 and text[close] == " " and text[close + 1] == "»":
            close += 2
        if covered[m.start()] and closes.isdisjoint(range(m.end(), close)):
            continue
        if covered[close]:
            continue
        nodes.append((close, "mark", m.start(), m.end(), close))
    for m in _LINE.finditer(text):
        if not covered[m.start()] or text.count("\n", m.start(), m.end()) > 1:
            nodes.append((m.start(), "line", m.start(), m.end(), m.start()))
    if _THAI.search(text):
        for m in re.finditer("(?<=[฀-๿0-9)\\]”\"])[ \t]+(?=[฀-๿A-Z\"“])", text):
            if not covered[m.start()]:
                nodes.append((m.start(), "gap", m.start(), m.end(), m.start()))
    if _EAST.search(text):
        for m in _EAST_GAP.finditer(text):
            if not covered[m.start()]:
                nodes.append((m.start(), "east", m.start(), m.end(), m.start()))
    nodes.sort()
    cuts = _best_path(text, nodes, words)
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            if out and not any(c.isalnum() for c in text[a:b]):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def split_sentences(df: DataFrame, key: str, text: str = "text", dictionary: DataFrame | None = None) -> DataFrame:
    """``key``, ``sentence_no`` (from 0), ``start_char``, ``end_char``, ``sentence``.

    Defined cases: null and blank texts have no sentence; a text without any end mark is one; marks
    alone belong to the sentence before, or are one if nothing else is there; repeated rows stay
    repeated; texts of any length are read whole. Words of spaceless scripts are learned from ``dictionary``,
    by default from ``df`` itself.
    """

    counts = df.sparkSession.sparkContext.broadcast(word_counts(dictionary if dictionary is not None else df, text))

    def run(batches):
        words = Dictionary(counts.value)
        for b in batches:
            rows, number, starts, ends, parts = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, (s, e) in enumerate(sentences(t, words)):
                    rows.append(i)
                    number.append(n)
                    starts.append(s)
                    ends.append(e)
                    parts.append(t[s:e])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())], names=[key, "sentence_no", "start_char", "end_char", "sentence"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(~blank(F.col(text))).select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, sentence_no int, start_char int, end_char int, sentence string")


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "segments"), "segment_id").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "segments").where(F.col("kind").isin("md", "docx", "odt", "inp")).select("segment_id", "text")
    return split_sentences(rows, "segment_id", dictionary=table(spark, d, "segments")).select("segment_id", "start_char", "end_char").distinct()


QUERIES = {"p1_found": p1_found, "p1_sentences": p1_sentences}
SQL: dict[str, str] = {}
