"""Sentences, scans, encodings, languages, look-alikes and abuse on small texts with known answers."""

import random

import numpy as np
import pytest

from lectern.llm.abuse import Boosted, Isotonic, score_documents
from lectern.llm.garbled import garbled, undo
from lectern.llm.langid import identify
from lectern.llm.lookalike import SLOTS, Former, one_form
from lectern.llm.scans import is_number, read_scans, reflow, skeleton
from lectern.llm.sentences import sentences, split_sentences

EN = "The clerk moved the old ledger to the north store before the meeting. Nobody asked why it was there."
FR = "Le greffier a déplacé le vieux registre dans le magasin du nord avant la réunion. Personne n'a demandé pourquoi il était là."
DE = "Der Schreiber brachte das alte Buch vor der Sitzung in das nördliche Lager. Niemand fragte, warum es dort gewesen war."
RU = "Секретарь перенёс старую книгу в северное хранилище до начала заседания. Никто не спросил, почему она там лежала."


def cut(t):
    return [t[a:b] for a, b in sentences(t)]


@pytest.mark.parametrize("text,want", [
    ("Dr. Low paid approx. 3.5 m to St. Ives Ltd. yesterday. It rained.", ["Dr. Low paid approx. 3.5 m to St. Ives Ltd. yesterday.", "It rained."]),
    ("She said “Stop. Go home.” and left. He stayed!", ["She said “Stop. Go home.” and left.", "He stayed!"]),
    ("Open points\nThe door\nwas shut. All was well.", ["Open points", "The door\nwas shut.", "All was well."]),
    ("Am 5. Januar kam er an. Er blieb bis 9 Uhr.", ["Am 5. Januar kam er an.", "Er blieb bis 9 Uhr."]),
    ("彼は「行く。帰る。」と言った。雨だ。", ["彼は「行く。帰る。」と言った。", "雨だ。"]),
    ("这是第一句。他写道：“东西不能带走。”第二句？", ["这是第一句。", "他写道：“东西不能带走。”", "第二句？"]),
    ("فهرست تیار ہے۔ کل آئیں؟ جی۔", ["فهرست تیار ہے۔", "کل آئیں؟", "جی۔"]),
    ("यह पहला वाक्य है। यह दूसरा है।", ["यह पहला वाक्य है।", "यह दूसरा है।"]),
    ("ฝ่ายกฎหมายเรียกคืนบันทึก เลขที่ AB-12ในคลัง เมื่อวันที่ 2 ตุลาคม 2015 ทีมคลังเอกสารส่งมอบกล่อง", ["ฝ่ายกฎหมายเรียกคืนบันทึก เลขที่ AB-12ในคลัง เมื่อวันที่ 2 ตุลาคม 2015", "ทีมคลังเอกสารส่งมอบกล่อง"]),
    ("The end.Now a new one came. Ok", ["The end.", "Now a new one came.", "Ok"]),
    ("", []), (None, []), (" \n ", []), ("!!!", ["!!!"]), ("no mark", ["no mark"]),
])
def test_sentences(text, want):
    assert cut(text) == want


def test_sentences_cover_every_character():
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice("ab A.B!?“”()«»\n 。ไทย1'\"") for _ in range(r.randint(0, 40)))
        got = sentences(t)
        covered = {i for a, b in got for i in range(a, b)}
        assert {i for i, c in enumerate(t) if not c.isspace()} <= covered
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_sentences_of_a_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "y"), (3, "x. " * 5000, None)], "id int, text string, sentence_no string")
    rows = split_sentences(df, "id")
    assert rows.where("id = 1").count() == 2 and rows.where("id = 2").count() == 0 and rows.where("id = 3").count() >= 1


@pytest.mark.parametrize("part,yes", [("26", True), ("- 3 -", True), ("[xiv]", True), ("Page 15 (16)", True), ("4/10", True), ("Seite 7", True), ("2012", False), ("2012.", False), ("of 3", False), ("mild", False)])
def test_page_numbers(part, yes):
    assert is_number(part) is yes


def test_scans(spark):
    clean = "the clerk told the auditor that the modern register was filed in the cabinet "
    page = "{t}\nthe clcrk to1d the audi-\ntor that the modern\nregister was filed.\n{n}"
    rows = [("c%d" % i, clean * 3, "p0", False) for i in range(9)]
    rows += [("s%d" % i, page.format(t="ANNUAL REPORT" if i % 2 else "Annual Repart", n=i + 1), "p1", True) for i in range(4)]
    rows += [("none", None, "p1", True), ("blank", "  ", "p1", True), ("alone", "the clerk told the auditor.", None, True)]
    df = spark.createDataFrame(rows + rows, "id string, text string, path string, scan boolean")
    got = {r.id: r for r in read_scans(df, "id", "text", "path", "scan").collect()}
    assert set(got) == {"s0", "s1", "s2", "s3", "alone"}
    assert got["alone"].defects == []
    assert set(got["s1"].defects) >= {"hyphenation", "misread", "page_number"}
    text = reflow(read_scans(df, "id", "text", "path", "scan").where("id = 's1'"), "id").collect()
    assert "the clerk told the auditor that the modern register was filed." in " ".join(r.text for r in text)
    assert skeleton("rnodern") == skeleton("modern") and skeleton("c1erk") == skeleton("clerk")
    assert read_scans(df.limit(0), "id", "text", "path", "scan").count() == 0


def test_encodings(spark):
    rows = [(f"i{k}", t, "text/plain", f"n{k}") for k, t in enumerate([EN, FR, DE, RU] * 12)]
    bad = {"u8": FR.encode().decode("cp1252", "replace").replace("�", ""), "mac": DE.encode("cp1252").decode("mac_roman"), "koi": RU.encode("koi8_r").decode("cp1251"), "lost": FR.replace("é", "�"), "twice": FR.encode().decode("latin_1").encode().decode("latin_1")}
    rows += [(k, t, None, None) for k, t in bad.items()] + [("none", None, None, None), ("blank", " ", "", "")]
    df = spark.createDataFrame(rows + rows, "id string, text string, media_type string, source_name string")
    best, _ = garbled(df, "id")
    assert {r.key for r in best.collect()} == set(bad)
    assert undo(bad["mac"].split()[2], ("mac_roman", "cp1252")) == DE.split()[2]
    assert garbled(df.limit(0), "id")[0].count() == 0


def test_languages(spark):
    rows = [(f"r{i}", t, c) for i in range(25) for t, c in ((EN, "en"), (FR, "French"), (DE, "de-AT"), (RU, "rus"))]
    rows += [("wrong", FR, "en"), ("und", DE, "und"), ("both", EN + " " + RU, "en"), ("none", None, "en"), ("digits", "12 34 " * 10, "en")]
    df = spark.createDataFrame(rows + rows, "id string, text string, lang string")
    got = {}
    for r in identify(df, "id").distinct().collect():
        got.setdefault(r.id, set()).add(r.lang)
    assert (got["wrong"], got["und"], got["both"]) == ({"fr"}, {"de"}, {"en", "ru"})
    assert "none" not in got and "digits" not in got
    assert identify(spark.createDataFrame([("x", EN, None)], "id string, text string, lang string"), "id").count() == 0


def test_one_form(spark):
    f = Former(np.zeros(SLOTS))
    cases = {"ｔｈｅ": "the", "the": "the", "café": "café", "no​te": "note", "a b": "a b", "well‑known": "well-known", "раgе": "page", "музeй": "музей", "ﬁle": "file", "𝐭𝐡𝐞": "the", "ｶﾞﾗｽ": "ガラス", "文（一）。": "文（一）。", "Größe – “x”": "Größe – “x”", "क्‍ष": "क्‍ष"}
    assert {k: f.form(k) for k in cases} == cases
    assert all(f.form(f.form(k)) == f.form(k) for k in cases)
    rows = one_form(spark.createDataFrame([("a", None), ("b", ""), ("c", "ｘ")], "id string, text string"), "id").collect()
    assert {(r.id, r.formed, r.changed) for r in rows} == {("a", None, False), ("b", "", False), ("c", "x", True)}


def test_boosting_and_calibration():
    r = np.random.default_rng(2)
    x = r.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    raw = Boosted().fit(x[:400], y[:400]).raw(x[400:])
    assert ((raw > 0) == y[400:]).mean() > 0.9
    p = Isotonic().fit(raw, y[400:]).of(np.sort(raw))
    assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1


def test_abuse(spark):
    r = random.Random(7)
    plain = ["The clerk moved box {} to the store.", "Rule {} against harassment was renewed.", "The rat problem in cellar {} was reported.", "You may read file {} at the desk."]
    bad = ["You are a worthless idiot, {}!", "Shut up, {}, you stupid parasite.", "All the {} are vermin and should be driven out.", "Drop dead, {}, you moron."]
    docs = [(i, r.choice(plain).format(f"AB-{i}") + (" " + r.choice(bad).format(f"Name{i % 9}") if i % 3 == 0 else " It rained."), "s") for i in range(240)]
    held = [(1000, "You are a w0rthless id*ot, Bob!", None), (1001, "The clerk moved box X-1.", None), (1002, None, None), (1003, "", "s")]
    labels = [(i, "v", "abusive" if i % 3 == 0 else "none") for i in range(240)] + [(5, "w", None), (None, "w", "none")]
    d = spark.createDataFrame(docs + held, "doc_id long, text string, source string")
    got = {x.doc_id: x.score for x in score_documents(d, spark.createDataFrame(labels, "doc_id long, reviewer string, label string")).collect()}
    assert got[1000] > 0.5 > got[1001] and got[1002] == got[1003] == 0.0
    assert sum((got[i] > 0.5) == (i % 3 == 0) for i in range(240)) > 230
    assert {x.score for x in score_documents(d, spark.createDataFrame([], "doc_id long, reviewer string, label string")).collect()} == {0.0}


def test_short_texts_have_a_language(spark):
    rows = [(f"r{i}", t, c) for i in range(25) for t, c in ((EN, "en"), (FR, "French"), (DE, "de-AT"), (RU, "rus"))]
    short = [("ok", "ok", "en"), ("note", "see note", None), ("ru", "да", None), ("de", "Lager", "de"), ("one", "é", "fr"), ("odd", "zq", "de"), ("two", "Ja. Ok.", "de")]
    df = spark.createDataFrame(rows + short + [("code", "AB-12", "en"), ("digits", "12", "en"), ("mark", "–", "en")], "id string, text string, lang string")
    got = {r.id: (r.lang, r.confidence) for r in identify(df, "id").collect()}
    assert {k for k, *_ in short} <= set(got) and not {"code", "digits", "mark"} & set(got)
    assert (got["ok"][0], got["ru"][0], got["de"][0], got["one"][0], got["odd"][0]) == ("en", "ru", "de", "fr", "de")
    assert all(0 < got[k][1] <= 1 for k, *_ in short) and got["odd"][1] < got["r0"][1]
    assert not {r.id for r in identify(df, "id", short=False).collect()} & {"ok", "note", "ru", "odd"}


@pytest.mark.parametrize("text,want", [
    ("会議は昨日終わりました　次の会議は来週です", ["会議は昨日終わりました", "次の会議は来週です"]),
    ("古い帳簿を倉庫に移した　しかし理由は誰も尋ねなかった", ["古い帳簿を倉庫に移した", "しかし理由は誰も尋ねなかった"]),
    ("届いた 書類を確認した", ["届いた 書類を確認した"]), ("第一章　総則", ["第一章　総則"]),
    ("档案馆收到了一批文件 工作人员已经完成登记", ["档案馆收到了一批文件", "工作人员已经完成登记"]),
    ("议题 预算", ["议题 预算"]), ("他们昨天晚上都在 北京的办公室里面", ["他们昨天晚上都在 北京的办公室里面"]),
])
def test_gaps_of_east_asian_text(text, want):
    assert cut(text) == want


def test_best_path_is_the_best_of_all():
    from itertools import combinations

    from lectern.llm import sentences as m

    r = random.Random(8)
    differs = 0
    for _ in range(150):
        n = r.randint(1, 6)
        text = "a" * (n + 1)
        worth = {(u, p): r.choice([-2.0, 1.0, 2.0, 5.0]) for u in range(n + 1) for p in range(u + 1, n + 1)}
        m_line, m._line_score = m._line_score, lambda t, unit, start, end: worth[unit, start]
        try:
            got = m._best_path(text, [(p, "line", p, p, p) for p in range(1, n + 1)])
        finally:
            m._line_score = m_line

        def total(cuts):
            places = [0, *cuts]
            if any(worth[u, p] <= 0 for u, p in zip(places, places[1:])):
                return None
            passed = sum(max(0.0, worth[u, x]) for u, p in zip(places, [*cuts, n + 1]) for x in range(u + 1, p))
            return sum(worth[u, p] for u, p in zip(places, places[1:])) - passed

        best = max(v for k in range(n + 1) for c in combinations(range(1, n + 1), k) if (v := total(c)) is not None)
        assert total(got) == best
        walk = []
        for p in range(1, n + 1):
            if worth[walk[-1] if walk else 0, p] > 0:
                walk.append(p)
        differs += total(walk) < best
    assert differs


def test_abuse_in_one_word_and_behind_a_hash():
    from lectern.llm.abuse import Features

    f = Features({})
    alone, you = "Idiot!", "Idiot, you are late."
    want = Features({}).row(you)
    assert any(f.row(alone)) and f.row(you) == want and any(want)
    assert not any(f.row("Closed.")) and "Idiot" not in f.cold
    assert any(f.row("You are an id#ot, they said.")) and any(f.row("You idio#!"))
    assert not any(f.row("# Title of the list")) and not any(f.row("Ticket #a12 was closed."))


def test_short_sentences_of_another_language(spark):
    rows = [(f"r{i}", t, c) for i in range(25) for t, c in ((EN, "en"), (FR, "fr"), (DE, "de"), (RU, "ru"))]
    rows += [("short", EN + " Она там лежала.", "en"), ("heading", EN + "\nОна там", "en"), ("name", EN + " Hofmann Lagerung.", "en")]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    got = {}
    for r in identify(df, "id").collect():
        got.setdefault(r.id, set()).add(r.lang)
    assert (got["short"], got["heading"], got["name"]) == ({"en", "ru"}, {"en"}, {"en"})


def test_words_are_learned_from_counts(spark):
    from lectern.llm.words import Dictionary, word_counts

    r = random.Random(1)
    words = ["档案馆", "检查", "清单", "温度", "记录本", "更换", "封存", "报告"]
    texts = ["".join(r.choice(words) for _ in range(6)) + "。" for _ in range(400)] + [None, "", "no such script"]
    learned = Dictionary(word_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert learned.cut("档案馆更换记录本", frozenset()) == ("档案馆", "更换", "记录本")
    assert learned.cut("检查温度", frozenset(["检"])) == ("检查", "温度")
    assert Dictionary().cut("档案馆", frozenset()) == ("档", "案", "馆")
    assert Dictionary(word_counts(spark.createDataFrame([], "text string"))).cut("档案", frozenset()) == ("档", "案")


def test_planted_decodings_are_found(spark):
    """Rows of the test data, decoded wrongly by several chains, half of them in sources of their own."""
    import pandas as pd

    from lectern.llm.garbled import _table

    seg = pd.read_parquet("/root/testdata/sf0.01/segments.parquet").drop_duplicates("segment_id")
    seg = seg[seg.text.notna() & ~seg.text.fillna("").map(str.isascii)].reset_index(drop=True)[["segment_id", "text", "source_name", "media_type", "lang"]]
    as_is = {r.key for r in garbled(spark.createDataFrame(seg.drop(columns="lang")), "segment_id")[0].collect()}
    sound = seg[~seg.segment_id.isin(as_is)]
    planted = set()
    for k, (d, e, lang) in enumerate([("cp1252", "utf_8", "fr"), ("mac_roman", "utf_8", "es"), ("mac_roman", "cp1252", "de"), ("cp437", "cp1252", "pt"), ("cp1251", "koi8_r", "ru"), ("latin_1", "euc_jp", "ja"), ("latin_1", "cp874", "th")]):
        n, rows = 0, sound[sound.lang.fillna("").str.lower().str.startswith(lang)]
        for i, r in rows.iterrows():
            try:
                t = "".join(_table(d)[b] for b in r.text.encode(e))
            except UnicodeError:
                continue
            # a language of which most is garbled gives nothing to compare with
            if n == min(10, len(rows) // 5) or r.segment_id in planted:
                continue
            n += 1
            seg.at[i, "text"] = t
            planted.add(r.segment_id)
            if n % 2:
                seg.at[i, "source_name"] = f"planted-{k}"
    got = {r.key for r in garbled(spark.createDataFrame(seg.drop(columns="lang")), "segment_id")[0].collect()}
    assert len(planted) >= 50
    assert len(got & planted) >= 0.95 * len(planted), (len(planted), sorted(seg[seg.segment_id.isin(planted - got)].text.str[:60]))
    assert len(got - planted - as_is) <= 0.01 * len(seg)
