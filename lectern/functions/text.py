"""Scalar functions over text, as Spark expressions where Spark has them."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line: the set that Python's ``splitlines`` knows. A fixed value.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
#: White space of Unicode as a class of Java regular expressions. A fixed value.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def folding() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F that are one ASCII letter with one mark, and those letters."""
    pairs = []
    for o in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(o).lower())
        if chr(o) == chr(o).lower() and len(d) == 2 and d[0].isascii() and d[0].isalpha() and unicodedata.combining(d[1]):
            pairs.append((chr(o), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = folding()
#: What a token of the full-text index is. A fixed value.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(c: Column) -> Column:
    """Lower-case, accent-folded runs of letters and digits; null for null."""
    return F.regexp_extract_all(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit(TOKEN), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(c, LINE_ENDS)


def strip(c: Column) -> Column:
    """Without white space of Unicode at both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{WHITE}+", " "))


def excerpt(c: Column, most: int = 180) -> Column:
    """Collapsed text of at most ``most`` characters, with an ellipsis where it is cut."""
    t = collapse(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def suffix(c: Column) -> Column:
    """Lower-case suffix of a file name with its dot; empty where there is none."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def segment_id(digest: Column, index: Column, locator: Column, text_digest: Column) -> Column:
    """SHA-256 of the four identifying values, joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", digest, index.cast("string"), locator, text_digest), 256)


def count_class(c: Column, chars: str) -> Column:
    """Characters of a class, counted in code points; 0 for null."""
    return F.coalesce(F.length(c) - F.length(F.regexp_replace(c, chars, "")), F.lit(0))


#: The ranges counted as Arabic.
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
#: The keys of locators in the order in which they are told.
LOCATOR_KEYS = ("page", "paragraph", "line", "sheet", "cell", "slide", "shape", "bounding_box", "timestamp_ms", "start_ms", "end_ms", "metadata_chunk")


def format_locator(c: Column) -> Column:
    """A JSON locator as ``key value, key value``: known keys in their order, then others sorted;
    ``document`` if there is none."""
    m = F.from_json(c, "map<string,string>")
    rest = F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, LOCATOR_KEYS))))
    keys = F.concat(F.filter(F.array(*map(F.lit, LOCATOR_KEYS)), lambda k: F.map_contains_key(m, k)), rest)
    told = F.transform(keys, lambda k: F.concat_ws(" ", F.replace(k, F.lit("_"), F.lit(" ")), F.coalesce(F.element_at(m, k), F.lit("null"))))
    return F.when(m.isNull() | (F.size(m) == 0), "document").otherwise(F.array_join(told, ", "))


def format_locator_short(c: Column) -> Column:
    """A JSON locator as sorted ``key value`` pairs; ``source`` if there is none."""
    m = F.from_json(c, "map<string,string>")
    told = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat_ws(" ", k, F.coalesce(F.element_at(m, k), F.lit("null"))))
    return F.when(m.isNull() | (F.size(m) == 0), "source").otherwise(F.array_join(told, ", "))


def json_payload(c: Column) -> Column:
    """The JSON object inside a model's answer: a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Home directories and the given values replaced."""
    out = F.regexp_replace(c, r"/(?:home|Users)/[^/\s\"']+", "<home>")
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("<redacted>")), secrets, out)


def relocate(c: Column, old: str, new: str) -> Column:
    """A path moved from below ``old`` to below ``new``; others stay."""
    below = c.startswith(old.rstrip("/") + "/") | (c == old)
    return F.when(below, F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_run_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_external(href: Column) -> Column:
    """Whether a reference leaves its document: it names a scheme or a host. Null for null."""
    return href.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)")
