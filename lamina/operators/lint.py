"""Lint: findings of files in order, their prescriptions, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators.rules import SEVERITIES, Inputs, evaluate
from lamina.plans.dsl import Directive, Prescription
from lamina.sources.footer import footers

ORDER = ["file", "severity_ord", "rule_ord", "location.index"]


def lint(spark: SparkSession, *locations: str, rules: list[str] | None = None, inputs: Inputs | None = None) -> DataFrame:
    """Findings for every file at locations, in order: by file, then suggestions before warnings, each in the order of rules and columns.

    ordinal numbers the findings of a file from 0. Files without row groups have none. Findings are few for each file; only footers, page headers and bounded samples are read."""
    found = evaluate(inputs or Inputs(footers(spark, *locations).cache()), rules)
    w = Window.partitionBy("file").orderBy("severity_ord", "rule_ord", "location.index")
    return found.withColumn("ordinal", F.row_number().over(w) - 1).orderBy("file", "ordinal")


def at_least(findings: DataFrame, severity: str = "suggestion") -> DataFrame:
    """Findings of a severity or a graver one."""
    return findings.where(F.col("severity_ord") >= SEVERITIES.index(severity))


def has_issue(findings: DataFrame) -> bool:
    """Whether there is a warning or an error."""
    return bool(findings.agg(F.max("severity_ord")).first()[0])


def located(location: Column) -> Column:
    """file, row_group[i] or column[i](path)."""
    return (
        F.when(location["kind"] == "file", F.lit("file")).when(location["kind"] == "row_group", F.format_string("row_group[%d]", location["index"]))
        .otherwise(F.format_string("column[%d](%s)", location["index"], location["path"]))
    )


def directive_text(d: Column) -> Column:
    """A directive struct as a line of the language."""
    return F.concat_ws(" ", F.lit("set"), d["scope"], d["path"], d["property"], d["value"])


def shown(findings: DataFrame) -> DataFrame:
    """(file, ordinal, text): findings as plain text, each directive on a line of its own."""
    fixes = F.concat_ws("", F.transform("directives", lambda d: F.concat(F.lit("\n  fix: "), directive_text(d))))
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule"), F.lit(" @ "), located(F.col("location")), F.lit(": "), F.col("message"), fixes)
    return findings.select("file", "ordinal", text.alias("text"))


COLORS = {"suggestion": "\x1b[36m", "warning": "\x1b[33m", "error": "\x1b[31m"}


def print_findings(findings: DataFrame, colored: bool = True) -> None:
    """Print findings, one after another: severity and rule, place, message, fixes."""
    rows = findings.select("severity", "rule", located(F.col("location")).alias("at"), "message", F.transform("directives", directive_text).alias("fixes"))
    for r in rows.toLocalIterator():
        mark, end = (COLORS[r.severity], "\x1b[0m") if colored else ("", "")
        print(f"{mark}{r.severity}{end} {r.rule}\n  --> {r.at}\n  {r.message}")
        for fix in r.fixes:
            print(f"  fix: {fix}")


def directives(findings: DataFrame) -> DataFrame:
    """(file, ordinal, scope, path, property, value): all directives of ordered findings, numbered through."""
    out = findings.select("file", "ordinal", F.posexplode("directives").alias("i", "d"))
    w = Window.partitionBy("file").orderBy("ordinal", "i")
    return out.select("file", (F.row_number().over(w) - 1).alias("ordinal"), "d.*")


def last_wins(df: DataFrame) -> DataFrame:
    """Of directives with one key in a file the last."""
    w = Window.partitionBy("file", "scope", "path", "property").orderBy(F.desc("ordinal"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def conflicts(df: DataFrame) -> DataFrame:
    """(file, scope, path, property, first, second, ordinal): for each key the first directive of another value than the first one with the key."""
    w = Window.partitionBy("file", "scope", "path", "property").orderBy("ordinal")
    other = df.withColumn("first", F.first("value").over(w)).where("value <> first")
    return other.groupBy("file", "scope", "path", "property").agg(F.min_by("first", "ordinal").alias("first"), F.min_by("value", "ordinal").alias("second"), F.min("ordinal").alias("ordinal"))


def prescription(findings: DataFrame) -> Prescription:
    """The directives of one file's findings, in order, as a prescription."""
    rows = directives(findings).orderBy("file", "ordinal").collect()
    return Prescription(Directive.parse(" ".join(x for x in ("set", r.scope, r.path, r.property, r.value) if x)) for r in rows)
