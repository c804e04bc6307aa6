"""Column expressions over words that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.llm.common import SPACE

_TRIM = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text: runs of characters that are no ASCII white space."""
    inner = F.btrim(text, F.lit(_TRIM))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def paired(hashes: Column, distance: int) -> Column:
    """Hashes of two runs of words, the second distance further: from hashes of runs of that many words to those of twice as many.

    hashes should be a plain column, as it is read twice."""
    n = F.greatest(F.size(hashes) - distance, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(distance + 1), n), lambda a, b: F.xxhash64(a, b))


def placed(hashes: Column) -> Column:
    """Pairs of hash and position, sorted."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(at: Column) -> Column:
    """Of placed() hashes the positions, in order, of those that occur twice or more. at should be a plain column, as it is read several times."""
    size = F.greatest(F.size(at) - 1, F.lit(0))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    # A pair counts if its neighbour before or after has the same hash.
    before, after = F.concat(none, F.slice(at, F.lit(1), size)), F.concat(F.slice(at, F.lit(2), size), none)
    same = F.zip_with(before, after, lambda b, a: F.struct(b["h"].alias("b"), a["h"].alias("a")))
    marked = F.zip_with(at, same, lambda x, s: F.when((x["h"] == s["b"]) | (x["h"] == s["a"]), x["i"]))
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def covered(places: Column, width: int) -> Column:
    """How many positions the windows of so many positions have that begin at the sorted places."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + width - F.greatest(acc["end"] - i, F.lit(0))).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])
