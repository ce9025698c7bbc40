"""Paths as Spark expressions: resolved, bounded to folders, judged by a source policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ledger import kind


def resolved(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled slashes; null for null, for a relative path and
    for one that climbs above the root."""
    parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
    step = lambda s, p: F.when(s.isNull() | ((p == "..") & (F.size(s) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def bounded(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path, once resolved, is one of the folders or lies below one; never null."""
    p = resolved(path)
    inside = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        inside = inside | (p == r) | p.startswith(r + "/")
    return F.coalesce(inside, F.lit(False))


def refusal(path: Column, name: Column, roots: tuple[str, ...], kinds: tuple[str, ...]) -> Column:
    """Why a source may not be read, by the first rule that it breaks; null if it may."""
    return (
        F.when(path.isNull(), "no path")
        .when(~bounded(path, roots), "outside the allowed folders")
        .when(~F.coalesce(kind(name).isin(*kinds), F.lit(False)), "kind is not allowed")
    )
