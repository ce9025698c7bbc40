"""Readers of zipped office formats: OOXML and OpenDocument, from bytes to segments.

Each reader gives (locator, text) pairs and raises ValueError for what is malformed, unsafe or beyond
the limits. Only the standard library is used.
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

#: Limits that keep a hostile file from filling a worker.
MOST_PACKAGE, MOST_MEMBER, MOST_TOTAL, MOST_FLAT = 256 << 20, 32 << 20, 128 << 20, 32 << 20
MOST_MEMBERS, MOST_RATIO, MOST_NODES = 4096, 200, 250_000
MOST_CHARS, MOST_BLANKS, MOST_COLUMNS, MOST_ROWS, MOST_CELLS = 2 << 20, 10_000, 16_384, 10_000, 50_000

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TAB = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_D = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
_PR = "{urn:oasis:names:tc:opendocument:xmlns:presentation:1.0}"
_MAN = "{urn:oasis:names:tc:opendocument:xmlns:manifest:1.0}"
_DB = "{urn:oasis:names:tc:opendocument:xmlns:database:1.0}"
_MATH = "{http://www.w3.org/1998/Math/MathML}"
_LINK = "{http://www.w3.org/1999/xlink}href"

Segments = list[tuple[dict, str]]


def xml(data: bytes) -> ET.Element:
    """A parsed document without declarations and entities, of a bounded number of nodes."""
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data, re.IGNORECASE):
        raise ValueError("declarations and entities are not allowed")
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e
    if sum(1 for _ in root.iter()) > MOST_NODES:
        raise ValueError("too many XML nodes")
    return root


class Package:
    """A checked zip file: safe and single names, known methods, sizes and ratios within limits."""

    def __init__(self, data: bytes) -> None:
        if len(data) > MOST_PACKAGE:
            raise ValueError("package is too large")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError("not a package") from e
        self.infos = self.zip.infolist()
        self.names = {i.filename for i in self.infos}
        faults = (
            (len(self.infos) > MOST_MEMBERS, "too many members"),
            (len(self.names) < len(self.infos), "duplicate member names"),
            (any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in self.names), "unsafe member path"),
            (any(i.flag_bits & 1 for i in self.infos), "encrypted member"),
            (any(i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in self.infos), "unknown compression"),
            (any(i.file_size > MOST_MEMBER for i in self.infos) or sum(i.file_size for i in self.infos) > MOST_TOTAL, "too large when unpacked"),
            (any(i.file_size > MOST_RATIO * i.compress_size for i in self.infos), "compression ratio is too high"),
        )
        for bad, why in faults:
            if bad:
                raise ValueError(why)

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise ValueError(f"member is missing: {name}")
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
            raise ValueError(f"damaged member: {name}") from e


def docx(data: bytes) -> Segments:
    body = xml(Package(data).read("word/document.xml")).find(f"{_W}body")
    out = []
    for n, p in enumerate([] if body is None else body.findall(f"{_W}p"), 1):
        parts = []
        for e in p.iter():
            parts.append(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" and e.get(f"{_W}val") is None else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else "")
        if (text := "".join(parts).strip()):
            out.append(({"paragraph": n}, text))
    return out


def _targets(p: Package, rels: str, base: str) -> dict[str, str]:
    return {r.get("Id", ""): (t[1:] if (t := r.get("Target", "")).startswith("/") else base + t) for r in xml(p.read(rels))}


def xlsx(data: bytes) -> Segments:
    """Each cell with a value; formulas stand as written, they are not evaluated."""
    p = Package(data)
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in xml(p.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in p.names else []
    place = _targets(p, "xl/_rels/workbook.xml.rels", "xl/")
    out = []
    for sheet in xml(p.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        for c in xml(p.read(place.get(sheet.get(f"{_R}id", ""), ""))).iter(f"{_S}c"):
            value, formula, kind = c.find(f"{_S}v"), c.find(f"{_S}f"), c.get("t", "n")
            if formula is not None:
                text = "=" + (formula.text or "")
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                if not value.text.isdigit() or int(value.text) >= len(shared):
                    raise ValueError("shared string is missing")
                text = shared[int(value.text)]
            elif kind == "b":
                text = "True" if value.text == "1" else "False"
            else:
                text = value.text
            out.append(({"cell": c.get("r", ""), "sheet": sheet.get("name", "")}, text))
    return out


def pptx(data: bytes) -> Segments:
    """The text of each top-level shape that has any."""
    p = Package(data)
    place = _targets(p, "ppt/_rels/presentation.xml.rels", "ppt/")
    out = []
    for n, slide in enumerate(xml(p.read("ppt/presentation.xml")).iter(f"{_P}sldId"), 1):
        tree = xml(p.read(place.get(slide.get(f"{_R}id", ""), ""))).find(f"{_P}cSld/{_P}spTree")
        shapes = [e for e in ([] if tree is None else tree) if e.tag in (f"{_P}sp", f"{_P}pic", f"{_P}graphicFrame", f"{_P}grpSp", f"{_P}cxnSp")]
        for m, shape in enumerate(shapes, 1):
            body = shape.find(f"{_P}txBody")
            if body is not None and (text := "\n".join("".join(t.text or "" for t in q.iter(f"{_A}t")) for q in body.iter(f"{_A}p")).strip()):
                out.append(({"shape": m, "slide": n}, text))
    return out


def _number(value: str | None, most: int) -> int:
    """A repeat count: 1 if it is not given."""
    if value is None:
        return 1
    if not value.isdigit() or not 0 < int(value) <= most:
        raise ValueError(f"repeat count out of range: {value}")
    return int(value)


def _flat(e: ET.Element) -> Iterator[str]:
    yield e.text or ""
    for child in e:
        if child.tag == f"{_T}s":
            yield " " * _number(child.get(f"{_T}c"), MOST_BLANKS)
        elif child.tag in (f"{_T}tab", f"{_T}line-break"):
            yield "\t" if child.tag == f"{_T}tab" else "\n"
        else:
            yield from _flat(child)
        yield child.tail or ""


def _said(e: ET.Element) -> str:
    text = "".join(_flat(e)).strip()
    if len(text) > MOST_CHARS:
        raise ValueError("segment is too long")
    return text


def _paragraphs(body: ET.Element) -> Segments:
    out, seen = [], {"heading": 0, "paragraph": 0}
    for e in body.iter():
        kind = {f"{_T}h": "heading", f"{_T}p": "paragraph"}.get(e.tag)
        if kind and (text := _said(e)):
            seen[kind] += 1
            level = e.get(f"{_T}outline-level") if kind == "heading" else None
            out.append(({kind: seen[kind]} | ({"level": _number(level, 10)} if level is not None else {}), text))
    return out


def _below(e: ET.Element, tag: str, stop: str | None = None) -> Iterator[ET.Element]:
    """The nearest elements of a tag below another, not looking into them nor into ``stop``."""
    for child in e:
        if child.tag == tag:
            yield child
        elif child.tag != stop:
            yield from _below(child, tag, stop)


def _cells(body: ET.Element) -> Segments:
    """Cells with a value or a formula, repeats written out within limits."""
    out: Segments = []
    rows = cells = 0
    for k, sheet in enumerate(_below(body, f"{_TAB}table"), 1):
        name, number = sheet.get(f"{_TAB}name") or f"Sheet {k}", 0
        for row in _below(sheet, f"{_TAB}table-row", f"{_TAB}table"):
            again = _number(row.get(f"{_TAB}number-rows-repeated"), MOST_ROWS)
            line, column = [], 1
            for c in row:
                if c.tag not in (f"{_TAB}table-cell", f"{_TAB}covered-table-cell"):
                    continue
                times = _number(c.get(f"{_TAB}number-columns-repeated"), MOST_COLUMNS)
                formula = c.get(f"{_TAB}formula")
                given = (c.get(f"{_O}{a}") for a in ("string-value", "value", "date-value", "time-value", "boolean-value", "currency"))
                value = _said(c) or next((v for v in given if v is not None), None)
                if value is not None or formula is not None:
                    line += [(column + i, value if value is not None else formula, formula) for i in range(times)]
                column += times
            rows, cells = rows + again, cells + (column - 1) * again
            if column - 1 > MOST_COLUMNS or rows > MOST_ROWS or cells > MOST_CELLS:
                raise ValueError("spreadsheet is too large")
            for r in range(number + 1, number + again + 1):
                out += [({"column": at} | ({"formula": f} if f is not None else {}) | {"row": r, "sheet": name}, text or "") for at, text, f in line]
            number += again
    return out


def _pages(body: ET.Element, key: str) -> Segments:
    out = []
    for n, page in enumerate(_below(body, f"{_D}page"), 1):
        for m, thing in enumerate((e for e in page if e.tag != f"{_PR}notes"), 1):
            said = [_said(e) for e in thing.iter() if e.tag in (f"{_T}p", f"{_T}h")]
            if (text := "\n".join(x for x in said if x)):
                out.append(({"object": m, key: n}, text))
    return out


def external_links(root: ET.Element) -> int:
    """Links that lead out of the package; they are counted and never followed."""
    return sum(1 for e in root.iter() if (h := e.get(_LINK)) and (h.startswith("//") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", h)))


#: The body of each OpenDocument kind by its suffix.
BODIES = {"odt": "text", "ott": "text", "odm": "text", "otm": "text", "fodt": "text", "ods": "spreadsheet", "ots": "spreadsheet", "fods": "spreadsheet", "odp": "presentation", "otp": "presentation", "fodp": "presentation", "odg": "drawing", "otg": "drawing", "fodg": "drawing"}


def _checked(data: bytes, mimetype: str) -> Package:
    p = Package(data)
    first = p.infos[0] if p.infos else None
    if first is None or first.filename != "mimetype" or first.compress_type != zipfile.ZIP_STORED or first.extra:
        raise ValueError("mimetype must come first and be stored")
    if p.read("mimetype") != mimetype.encode():
        raise ValueError("mimetype does not fit")
    manifest = xml(p.read("META-INF/manifest.xml"))
    if manifest.find(f".//{_MAN}encryption-data") is not None:
        raise ValueError("encrypted package")
    kinds = [(e.get(f"{_MAN}full-path"), e.get(f"{_MAN}media-type")) for e in manifest.iter(f"{_MAN}file-entry")]
    if kinds.count(("/", mimetype)) != 1 or sum(k == "/" for k, _ in kinds) != 1 or kinds.count(("content.xml", "text/xml")) != 1 or sum(k == "content.xml" for k, _ in kinds) != 1:
        raise ValueError("manifest does not fit")
    return p


def content_of(data: bytes, suffix: str, mimetype: str) -> ET.Element:
    """The content of an OpenDocument file, packed or flat."""
    if not suffix.startswith("fod"):
        return xml(_checked(data, mimetype).read("content.xml"))
    if len(data) > MOST_FLAT:
        raise ValueError("flat document is too large")
    return xml(data)


def open_document(data: bytes, suffix: str, mimetype: str) -> Segments:
    return segments_in(content_of(data, suffix, mimetype), suffix)


def segments_in(root: ET.Element, suffix: str) -> Segments:
    if suffix == "odf":
        parts = [t.strip() for t in root.itertext() if t.strip()]
        source = next((e.text for e in root.iter(f"{_MATH}annotation") if e.text), None)
        text = source.strip() if source else " ".join(parts)
        return [({"formula": 1, "representation": "source" if source else "text"}, text)] if text else []
    bodies = root.findall(f"{_O}body/{_O}{BODIES[suffix]}")
    if len(bodies) != 1:
        raise ValueError("document body does not fit its kind")
    kind = BODIES[suffix]
    if kind == "text":
        return _paragraphs(bodies[0])
    return _cells(bodies[0]) if kind == "spreadsheet" else _pages(bodies[0], "slide" if kind == "presentation" else "page")


def odb(data: bytes, mimetype: str) -> Segments:
    """Names of a database file's tables, queries, forms and reports, each once; never their content."""
    root = xml(_checked(data, mimetype).read("content.xml"))
    groups = (("table", (f"{_DB}table-representation", f"{_DB}table-definition")), ("query", (f"{_DB}query",)), ("form", (f"{_DB}forms",)), ("report", (f"{_DB}reports",)))
    out = []
    for kind, tags in groups:
        found = []
        for tag in tags:
            for e in root.iter(tag):
                found += [c.get(f"{_DB}name") for c in e.iter(f"{_DB}component")] if kind in ("form", "report") else [e.get(f"{_DB}name")]
        names = list(dict.fromkeys(n.strip() for n in found if n and n.strip()))
        out += [({"database_object": kind, "index": i, "name": n}, n) for i, n in enumerate(names, 1)]
    return out


def odb_counts(segments: Segments) -> dict:
    """How many tables, queries, forms and reports a database file names."""
    kinds = [k["database_object"] for k, _ in segments]
    return {k: kinds.count(k) for k in ("table", "query", "form", "report")}


def wav(data: bytes) -> dict:
    """Channels, rate and duration of a sound file."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return {"channels": w.getnchannels(), "frame_rate": w.getframerate(), "sample_width": w.getsampwidth(), "duration_seconds": w.getnframes() / w.getframerate()}
    except (wave.Error, EOFError, ZeroDivisionError) as e:
        raise ValueError("malformed sound file") from e


def image(data: bytes) -> dict:
    """Width and height of a PNG or JPEG file, from its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 33 and data[12:16] == b"IHDR":
        width, height = struct.unpack(">II", data[16:24])
        return {"width": width, "height": height, "format": "PNG"}
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return {"width": width, "height": height, "format": "JPEG"}
        at += 2 + length
    raise ValueError("malformed image file")
