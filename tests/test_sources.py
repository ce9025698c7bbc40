import io
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.engine import Archive
from lectern.sources import inpage, packages, scan

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
ODT = "application/vnd.oasis.opendocument.text"
NS = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("text", "text"), ("table", "table"), ("draw", "drawing"), ("presentation", "presentation")))


def zipped(members, stored=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in members.items():
            z.writestr(n, d, zipfile.ZIP_STORED if n in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def odf(body, mimetype=ODT, manifest=None):
    m = manifest or f'<m:manifest xmlns:m="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><m:file-entry m:full-path="/" m:media-type="{mimetype}"/><m:file-entry m:full-path="content.xml" m:media-type="text/xml"/></m:manifest>'
    return zipped({"mimetype": mimetype, "content.xml": f"<office:document-content {NS}><office:body>{body}</office:body></office:document-content>", "META-INF/manifest.xml": m}, ("mimetype",))


def docx():
    return zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three marker</w:t></w:r></w:p></w:body></w:document>"})


def test_ooxml():
    assert packages.docx(docx()) == [({"paragraph": 1}, "one"), ({"paragraph": 3}, "three marker")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = '<Relationships><Relationship Id="r1" Target="{}"/></Relationships>'
    book = zipped({"xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="É" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel.format("worksheets/a.xml"), "xl/sharedStrings.xml": f"<sst {s}><si><t>word</t></si></sst>", "xl/worksheets/a.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>A1+1</f><v>3</v></c><c r="C1"/><c r="D1" t="b"><v>1</v></c></row></sheetData></worksheet>'})
    assert packages.xlsx(book) == [({"cell": "A1", "sheet": "É"}, "word"), ({"cell": "B1", "sheet": "É"}, "=A1+1"), ({"cell": "D1", "sheet": "É"}, "True")]
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    deck = zipped({"ppt/presentation.xml": f'<p:presentation {p} {r}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel.format("slides/a.xml"), "ppt/slides/a.xml": f"<p:sld {p}><p:cSld><p:spTree><p:sp/><p:sp><p:txBody><a:p><a:r><a:t>hello</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"})
    assert packages.pptx(deck) == [({"shape": 2, "slide": 1}, "hello")]
    assert scan.canonical({"sheet": "É", "cell": "A1"}) == '{"cell":"A1","sheet":"\\u00c9"}'


def test_open_document():
    text = "<office:text><text:h text:outline-level='2'>Head</text:h><text:p>a<text:s text:c='2'/>b<text:tab/>c</text:p><text:p/><text:p>d<text:line-break/>e</text:p></office:text>"
    assert packages.open_document(odf(text), "odt", ODT) == [({"heading": 1, "level": 2}, "Head"), ({"paragraph": 1}, "a  b\tc"), ({"paragraph": 2}, "d\ne")]
    ods = "application/vnd.oasis.opendocument.spreadsheet"
    cells = "<office:spreadsheet><table:table table:name='S'><table:table-row table:number-rows-repeated='2'><table:table-cell/><table:table-cell table:number-columns-repeated='2' office:value='7'/><table:table-cell table:formula='=A1'/></table:table-row></table:table></office:spreadsheet>"
    got = packages.open_document(odf(cells, ods), "ods", ods)
    assert [(x["row"], x["column"], t) for x, t in got] == [(1, 2, "7"), (1, 3, "7"), (1, 4, "=A1"), (2, 2, "7"), (2, 3, "7"), (2, 4, "=A1")]
    odp = "application/vnd.oasis.opendocument.presentation"
    page = "<office:presentation><draw:page><draw:frame><text:p>x</text:p></draw:frame><presentation:notes><text:p>n</text:p></presentation:notes><draw:frame/><draw:frame><text:p>y</text:p></draw:frame></draw:page></office:presentation>"
    assert packages.open_document(odf(page, odp), "odp", odp) == [({"object": 1, "slide": 1}, "x"), ({"object": 3, "slide": 1}, "y")]


@pytest.mark.parametrize("data", [
    b"", b"no zip", odf("<office:text/>", "text/other"), odf("<office:drawing/>"), zipped({"content.xml": "<x/>", "mimetype": ODT}, ("mimetype",)), zipped({"mimetype": ODT, "../x": "a"}, ("mimetype",)),
    odf("<office:text><text:p><text:s text:c='999999'/></text:p></office:text>"), zipped({"mimetype": ODT, "content.xml": b"a" * 4_000_000, "META-INF/manifest.xml": "<x/>"}, ("mimetype",)), zipped({"mimetype": ODT, "content.xml": "<!DOCTYPE x><x/>", "META-INF/manifest.xml": "<!ENTITY a 'b'>"}, ("mimetype",)),
])
def test_hostile_packages(data):
    with pytest.raises(ValueError):
        packages.open_document(data, "odt", ODT)


def compound(name, payload):
    """A compound file of one stream of at least 4096 bytes."""
    payload = payload.ljust(4096, b"\0")
    n = -(-len(payload) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [i + 3 for i in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(title, kind, start, size):
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, size)

    head = inpage.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIII", 1, 1, 0, 4096) + struct.pack("<IIII", 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * (108 * 4)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(payload))).ljust(512, b"\0")
    return head + struct.pack("<128I", *fat) + directory + payload.ljust(n * 512, b"\0")


def test_inpage():
    new = b"\x00\x00" + "سلام دنیا".encode("utf-16-le") + b"\x01\x00" + "abc".encode("utf-16-le") + b"\x01\x00" + "سلام دنیا".encode("utf-16-le")
    assert inpage.read(compound("InPage300", new)) == [({"byte_offset": 2, "part": 1, "stream": "InPage300"}, "سلام دنیا")]
    old = b"".join(bytes([c, 4]) for c in (0x81, 0x82, 0x83, 0x84)) + b"\x00\x01" * 5 + b"".join(bytes([c, 4]) for c in b"word")
    assert [t for _, t in inpage.read(compound("InPage100", old))] == ["ابپت", "word"]
    assert inpage.classify("x.inp", compound("InPage300", new)) == "inpage_cfb_candidate"
    assert inpage.classify("x.inp", b"abc") == "unrelated_inp" and inpage.classify("x.inp", inpage.MAGIC) == "malformed"
    assert inpage.pieces("a" * 9000) == ["a" * 4000, "a" * 4000, "a" * 1000]
    loop = bytearray(compound("InPage300", new))
    loop[512 + 8 : 512 + 12] = struct.pack("<I", 2)
    with pytest.raises(ValueError):
        inpage.read(bytes(loop))


def test_media():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    assert packages.wav(out.getvalue())["duration_seconds"] == 0.5
    assert packages.image(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 3, 4) + b"\0" * 9)["height"] == 4
    for f in (packages.wav, packages.image):
        with pytest.raises(ValueError):
            f(b"RIFFxxxx")


def test_lines_of_tsv(spark):
    rows = spark.createDataFrame([(5, 1, 1, 1, 1, 2, 30, 10, 20, 8, 90.0, "world"), (5, 1, 1, 1, 1, 1, 5, 9, 20, 8, -1.0, "hello"), (4, 1, 1, 1, 1, 0, 0, 0, 99, 99, -1.0, ""), (5, 1, 1, 1, 2, 1, 5, 30, 10, 8, -1.0, " x ")], "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string")
    got = [(r.line, r.text, r.x, r.y, r.width, r.height, r.confidence) for r in scan.tsv_lines(rows).orderBy("line").collect()]
    assert got == [(1, "hello world", 5, 9, 45, 9, 90.0), (2, "x", 5, 30, 10, 8, None)]


def test_archive_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("first line\n\nretention rule marker\n")
    (src / "b.md").write_text("first line\n\nretention rule marker\n")
    (src / "c.docx").write_bytes(docx())
    (src / "bad.docx").write_bytes(b"broken")
    (src / "d.exe").write_bytes(b"x")
    (src / "e.txt").write_bytes(b"\xff\xfe\x00bad")
    (src / "f.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    a = Archive(spark, str(tmp_path / "home"))
    got = a.add(str(src))
    assert (got["duplicates"], got["skipped"]) == (1, 3)
    again = a.add(str(src))
    assert again["added"] == 0
    assert a.rebuild()["segments"] == 4
    hit = a.find("retention rule").first()
    assert hit.locator_json == '{"line":3}' and hit.source_name == "a.txt"
    assert a.ask("Where is the retention rule?")["state"] == "blocked_by_policy"
    ok = a.ask("Where is the retention rule?", lambda p: '{"paragraphs":[{"text":"there","citation_ids":["CIT-1"]}]}')
    assert ok["state"] == "succeeded"
    assert a.ask("Where is the retention rule?", lambda p: '{"paragraphs":[{"text":"x","citation_ids":["CIT-99"]}]}')["state"] == "partially_produced_but_invalid"
    assert a.ask("Where is the retention rule?", lambda p: 1 / 0)["state"] == "failed"
    rows, errors = a.report("T", "retention rule")
    assert rows.count() == 4 and errors.count() == 0
    run = a.run_task('{"query": "retention rule", "title": "T"}')
    assert run["state"] == "succeeded" and a.verify_task(run["run_id"]) == []
    assert a.run_task('{"query": "nowhere to be found"}')["state"] == "partially_produced_but_invalid"
    assert a.verify_task("none") == ["no such task"]
    assert a.doctor() == []

    import shutil

    # sources may vanish: what was added stays
    shutil.rmtree(src)
    assert a.rebuild()["segments"] == 4 and a.rebuild(reuse=True)["segments"] == 4
    one = a.table("objects").where("media_type = 'text/plain'").select("sha256").limit(1)
    assert a.rebuild(only=one)["segments"] == 4
    assert a.damaged().count() == 0
    assert a.find("retention rule").first().segment_id == hit.segment_id
    a.backup(str(tmp_path / "copy"))
    b = Archive.restore(spark, str(tmp_path / "copy"), str(tmp_path / "new"))
    assert b.status() == a.status()
    assert b.find("retention rule").first().segment_id == hit.segment_id
    with pytest.raises(FileExistsError):
        Archive.restore(spark, str(tmp_path / "copy"), str(tmp_path / "new"))


def test_sources_outside_the_roots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one line")
    a = Archive(spark, str(tmp_path / "home"), roots=(str(tmp_path / "other"),))
    assert a.add(str(tmp_path / "in"))["skipped"] == 1
    assert a.table("ingestions").first().error == "outside the allowed folders"
    b = Archive(spark, str(tmp_path / "home2"), roots=(str(tmp_path / "in"),))
    assert b.add(str(tmp_path / "in"))["added"] == 1


def test_paths(spark):
    from lectern.functions import paths

    rows = spark.createDataFrame([("/a/b/../c",), ("/a/../../x",), ("a/b",), ("//a/./b/",), ("/",), (None,), ("/ab",)], "p string")
    got = rows.select(paths.resolved(F.col("p")).alias("r"), paths.bounded(F.col("p"), ("/a",)).alias("b")).collect()
    assert [(x.r, x.b) for x in got] == [("/a/c", True), (None, False), (None, False), ("/a/b", True), ("/", False), (None, False), ("/ab", False)]


def test_stream(spark, tmp_path):
    from lectern.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    for n, rows in enumerate((["a", "b", "a"], ["b", "c", None])):
        spark.createDataFrame([(x, i) for i, x in enumerate(rows)], "sha256 string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sha256 string, n int").parquet(str(tmp_path / "in"))
        ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b", "c"]


def test_records(spark):
    from lectern.sources import records as R

    c = '{"segment_id":"s","segment_index":1,"locator":{"line":3}}'
    files = [("a", c), ("b", f"[{c}]"), ("c", f'{{"retrieved_citations":[{{"citation":{c}}}]}}'), ("d", "broken"), ("e", '{"sources":[]}'), ("f", '{"x":1}'), ("g", None)]
    got = {r.path: (r.citation and r.citation.segment_id, r.error) for r in R.citation_files(spark.createDataFrame(files, "path string, value string")).collect()}
    assert got["a"] == got["b"] == got["c"] == ("s", None)
    assert [got[k][1] for k in "defg"] == ["not a citation file", "citation number is out of range", "citation is invalid", "not a citation file"]
    assert R.task('{"query":"x"}')["max_sources"] == 8
    for bad in ("", "[]", "{}", '{"query":" "}', '{"query":"x","max_sources":51}', '{"query":"x","odd":1}', '{"query":"x","render":1}'):
        with pytest.raises(ValueError):
            R.task(bad)
    rows = spark.createDataFrame([('{"a":{"Key":"v","p":"/home/u/x y"}}',), ("see /Users/u/z",), (None,)], "j string")
    assert [r.j for r in R.redacted(rows, "j", ("key",)).collect()] == ['{"a": {"Key": "[redacted]", "p": "[redacted-path] y"}}', "see [redacted-path]", None]
    assert R.leaking(rows, "j", ("Key",)).count() == 2
    assert R.recognition_languages(["ara", "urd", "eng", "osd"]) == (["eng", "urd", "ara"], []) and R.recognition_languages(["osd", "fra"]) == (["fra"], []) and R.recognition_languages([], "eng,x") == (["eng", "x"], ["eng", "x"])
    pages = spark.createDataFrame([("o", 3, [2]), ("p", 0, None), ("q", 1, None)], "object_sha256 string, page_count int, pages_with_text array<int>")
    assert {(r.object_sha256, r.page) for r in R.pages_without_text(pages).collect()} == {("o", 1), ("o", 3), ("q", 1)}
