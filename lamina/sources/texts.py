"""Text inputs: manifests of locations, prescriptions and folders of prescriptions."""

from __future__ import annotations

import os
import re
import shutil
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.dsl import Prescription


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(idx, location) of a manifest: one location a line, # starts a comment, blank lines count for nothing; idx counts from 0 in file order.

    A manifest is a short text; it's read as one row and split, so its order is kept."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    named = lines.select("line", F.trim(F.element_at(F.split("value", "#"), 1)).alias("location")).where("location <> ''")
    order = named.select(F.sort_array(F.collect_list(F.struct("line", "location"))).alias("all")).select(F.posexplode("all").alias("idx", "x"))
    return order.select("idx", F.col("x.location").alias("location"))


def read_prescription(path: str) -> Prescription:
    """The prescription in a text file."""
    with open(path, encoding="utf-8") as f:
        return Prescription.parse(f.read())


def read_prescriptions(folder: str, locations: int) -> list[tuple[int, Prescription]]:
    """The prescriptions of a folder by index, in order: files <number>.prescription; other names are passed over, an index with no location is an error."""
    out = []
    for name in os.listdir(folder):
        if m := re.fullmatch(r"(\d+)\.prescription", name):
            if int(m[1]) >= locations:
                raise ValueError(f"{name}: there are only {locations} locations")
            out.append((int(m[1]), read_prescription(os.path.join(folder, name))))
    return sorted(out, key=lambda x: x[0])


def fetch_if_missing(location: str, path: str) -> bool:
    """Copy a location to a local path, in a stream, unless the file is there; whether it was copied."""
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = path + ".part"
    if "://" not in location:
        shutil.copyfile(location, part)
    else:
        with urllib.request.urlopen(location) as source, open(part, "wb") as to:
            shutil.copyfileobj(source, to, 1 << 20)
    os.replace(part, path)
    return True
