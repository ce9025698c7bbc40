"""Text of InPage files: a compound file's stream, its runs of text, its segments."""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np

#: Fixed values of the compound file format.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END_OF_CHAIN, FREE, LAST_SECTOR = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFA
MOST_SECTORS = 65_536
LONGEST, LEAST, MOST_SEGMENTS, GAP = 4000, 4, 50_000, 4

#: Fixed values of the file format: what the low bytes of the older encoding stand for. Bytes that stand
#: for nothing certain have no entry.
OLD = {
    0x20: " ", 0x81: "ا", 0x82: "ب", 0x83: "پ", 0x84: "ت", 0x85: "ٹ", 0x86: "ث", 0x87: "ج",
    0x88: "چ", 0x89: "ح", 0x8A: "خ", 0x8B: "د", 0x8C: "ڈ", 0x8D: "ذ", 0x8E: "ر", 0x8F: "ڑ",
    0x90: "ز", 0x91: "ژ", 0x92: "س", 0x93: "ش", 0x94: "ص", 0x95: "ض", 0x96: "ط", 0x97: "ظ",
    0x98: "ع", 0x99: "غ", 0x9A: "ف", 0x9B: "ق", 0x9C: "ک", 0x9D: "گ", 0x9E: "ل", 0x9F: "م",
    0xA0: "ن", 0xA1: "ں", 0xA2: "و", 0xA3: "ئ", 0xA4: "ی", 0xA5: "ے", 0xA6: "ہ", 0xA7: "ھ",
    0xA8: "ٍ", 0xA9: " ", 0xAA: "ِ", 0xAB: "َ", 0xAC: "ُ", 0xAD: "ّ", 0xAE: "ؑ", 0xAF: " ",
    0xB0: "ٖ", 0xB1: "ْ", 0xB2: " ", 0xB3: "ٓ", 0xB4: "ْ", 0xB5: "ٌ", 0xB6: "ؤ", 0xB7: "ء",
    0xB8: "ي", 0xB9: "ۃ", 0xBA: " ", 0xBB: " ", 0xBC: " ", 0xBD: "ٰ", 0xBE: "ٗ", 0xBF: "ٔ",
    0xC0: " ", 0xC1: " ", 0xC2: " ", 0xC3: " ", 0xC4: " ", 0xC5: " ", 0xC6: " ", 0xC7: "ً",
    0xC8: "آ", 0xC9: " ", 0xCA: "إ", 0xCB: "ﷲ", 0xCC: " ", 0xCD: " ", 0xCE: ":", 0xCF: "ؔ",
    0xD0: "۰", 0xD1: "۱", 0xD2: "۲", 0xD3: "۳", 0xD4: "۴", 0xD5: "۵", 0xD6: "۶", 0xD7: "۷",
    0xD8: "۸", 0xD9: "۹", 0xDA: "!", 0xDD: " ", 0xDE: "٪", 0xDF: "/", 0xE0: "…", 0xE1: ")",
    0xE2: "(", 0xE3: " ", 0xE4: "+", 0xE5: " ", 0xE6: "ؓ", 0xE7: "ؒ", 0xE8: "٭", 0xE9: ":",
    0xEA: "؛", 0xEB: "×", 0xEC: "=", 0xED: "،", 0xEE: "؟", 0xEF: "÷", 0xF0: " ", 0xF1: "؍",
    0xF2: "؎", 0xF3: "۔", 0xF4: " ", 0xF5: "ـ", 0xF7: "؁", 0xF8: "ؐ", 0xF9: " ", 0xFA: "[",
    0xFB: "]", 0xFC: ".", 0xFD: "’", 0xFE: "‘", 0xFF: " ",
}
_ARABIC = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
_USEFUL = re.compile(f"[{_ARABIC}]|[A-Za-z]{{2}}")
#: What text of the newer encoding consists of: blanks, ASCII, Arabic, direction marks and joiners.
_TEXT = re.compile(f"[\t\n\f\r\u0020-\u007e\u00a0{_ARABIC}\u061c\u200c-\u200f\u202a-\u202e\u2066-\u2069]+")


def _chain(table: list[int], first: int) -> list[int]:
    out, seen = [], set()
    while first != END_OF_CHAIN:
        if first >= len(table) or first in seen:
            raise ValueError("compound file has a broken or circular chain")
        seen.add(first)
        out.append(first)
        first = table[first]
    return out


class Compound:
    """The streams of a compound file. Chains are checked against cycles and the file's size."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        shift, small = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small != 6:
            raise ValueError("compound file has strange sector sizes")
        self.size = 1 << shift
        self.data = data
        fat_count, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff = struct.unpack_from("<I", data, 56)[0]
        first_mini, _, first_difat, _ = struct.unpack_from("<IIII", data, 60)
        if fat_count > MOST_SECTORS:
            raise ValueError("compound file has too many sectors")
        places = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while first_difat < LAST_SECTOR:
            if first_difat in seen:
                raise ValueError("compound file has a circular chain")
            seen.add(first_difat)
            *more, first_difat = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat))
            places += more
        places = [p for p in places if p < LAST_SECTOR][:fat_count]
        self.fat = [x for p in places for x in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        raw = b"".join(self._sector(s) for s in _chain(self.fat, first_dir))
        self.entries = []
        for at in range(0, len(raw) - 127, 128):
            length = struct.unpack_from("<H", raw, at + 64)[0]
            kind = raw[at + 66]
            if kind and 2 <= length <= 64:
                name = raw[at : at + length - 2].decode("utf-16-le", "replace")
                start, size = struct.unpack_from("<IQ", raw, at + 116)
                self.entries.append((name, kind, start, size & 0xFFFFFFFF))
        root = next((e for e in self.entries if e[1] == 5), None)
        self.mini_fat = [x for s in _chain(self.fat, first_mini) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))] if first_mini < LAST_SECTOR else []
        self.mini = b"".join(self._sector(s) for s in _chain(self.fat, root[2])) if root and root[2] < LAST_SECTOR else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at + self.size > len(self.data) + self.size - 1 and at >= len(self.data):
            raise ValueError("compound file is cut short")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def stream(self, name: str) -> bytes:
        for n, kind, start, size in self.entries:
            if n == name and kind == 2:
                if size < self.cutoff:
                    parts = [self.mini[i * 64 : i * 64 + 64] for i in _chain(self.mini_fat, start)] if size else []
                else:
                    parts = [self._sector(s) for s in _chain(self.fat, start)]
                return b"".join(parts)[:size]
        raise ValueError(f"no such stream: {name}")


def classify(name: str, data: bytes, most: int = 64 << 20) -> str:
    """What kind of file an ``.inp`` file is."""
    if len(data) > most:
        return "oversize"
    if data[:8] != MAGIC:
        return "unrelated_inp" if name.lower().endswith(".inp") else "not_ole"
    try:
        names = [n for n, kind, *_ in Compound(data).entries if kind == 2]
    except (ValueError, struct.error):
        return "malformed"
    if any(re.fullmatch(r"inpage\d{3}", n, re.IGNORECASE) for n in names):
        return "split_inpage_cfb_candidate" if re.search(r"\.b\d{2}$", name, re.IGNORECASE) else "inpage_cfb_candidate"
    return "unrelated_cfb"


def runs_new(stream: bytes) -> list[tuple[int, str]]:
    """Runs of text in UTF-16, with the byte at which each begins."""
    units = stream[: len(stream) // 2 * 2].decode("utf-16-le", "surrogatepass")
    # a unit beyond the plane of two bytes cannot be text here; places count units
    flat = "".join(c if ord(c) < 0x10000 else "\0\0" for c in units)
    return [(m.start() * 2, m[0]) for m in _TEXT.finditer(flat)]


def _units_old() -> list[str]:
    """What each low byte of a two-byte unit stands for; empty where it ends a run."""
    return ["\n" if b in (10, 13) else chr(b) if 0x20 <= b <= 0x7E else OLD.get(b, "") for b in range(256)]


_OLD_UNITS = np.array(_units_old(), dtype=object)
_OLD_SOUND = np.array([bool(x) for x in _OLD_UNITS])


def runs_old(stream: bytes) -> list[tuple[int, str]]:
    """Runs of text in the older encoding, with the byte at which each begins.

    A unit is two bytes, the second of them 4; line ends have a 0 there. Other units are passed over: a
    run goes on behind them unless they are more than ``GAP`` bytes.
    """
    units = np.frombuffer(stream, dtype="<u2", count=len(stream) // 2)
    low, high = units & 0xFF, units >> 8
    at = np.flatnonzero((high == 4) | (high == 0) & ((low == 10) | (low == 13)))
    if not len(at):
        return []
    # a unit of the text's kind without a character ends a run as a long gap does
    sound = _OLD_SOUND[low[at]] & ~((high[at] == 4) & ((low[at] == 10) | (low[at] == 13)))
    apart = np.diff(at, prepend=at[0]) * 2 > GAP
    number = np.cumsum(apart | ~sound)
    at, number = at[sound], number[sound]
    if not len(at):
        return []
    borders = np.append(np.flatnonzero(np.diff(number, prepend=number[0] - 1)), len(at))
    letters = _OLD_UNITS[low[at]]
    return [(int(at[a]) * 2, "".join(letters[a:b])) for a, b in zip(borders[:-1], borders[1:])]


#: The next piece of a line: to its end if that is near, else to the last blank of the second half, else as long as a piece may be.
_NEXT_PIECE = re.compile(rf"(?s).{{1,{LONGEST}}}\Z|.{{{LONGEST // 2},{LONGEST}}}(?= )|.{{{LONGEST}}}")


def pieces(line: str) -> list[str]:
    """A line in pieces of bounded length, cut at blanks where there are any in the second half."""
    out, rest = [], line.strip()
    while rest:
        piece = _NEXT_PIECE.match(rest)[0]
        out.append(piece.strip())
        rest = rest[len(piece) :].strip()
    return [p for p in out if p]


def useful(text: str) -> bool:
    return len(text.strip()) >= LEAST and bool(_USEFUL.search(text))


def read(data: bytes) -> list[tuple[dict, str]]:
    """Segments of an InPage file, each text once."""
    file = Compound(data)
    names = [n for n, kind, *_ in file.entries if kind == 2 and re.fullmatch(r"inpage\d{3}", n, re.IGNORECASE)]
    if not names:
        raise ValueError("no InPage stream")
    name = max(names)
    old = name[-3:] < "300"
    out, seen = [], set()
    for at, run in (runs_old if old else runs_new)(file.stream(name)):
        if not useful(run):
            continue
        clean = unicodedata.normalize("NFC", run.replace("\r\n", "\n").replace("\r", "\n"))
        parts = [p for line in clean.split("\n") for p in pieces(line)]
        for n, text in enumerate(parts, 1):
            if useful(text) and text not in seen:
                seen.add(text)
                out.append(({"byte_offset": at, "part": n, "stream": "InPage100" if old else "InPage300"}, text))
                if len(out) > MOST_SEGMENTS:
                    raise ValueError("too many segments")
    return out
