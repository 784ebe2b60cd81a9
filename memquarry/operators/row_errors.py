"""Raw delimited records split into typed rows and rejected rows with reasons.

Every field is first a nullable text; rules over whole columns then give each
record an array of errors, and the records are split by whether it is empty. All
of it is built-in expressions in one pass over the table, without a shuffle.

Defined results: a null record has no fields and fails as ``column_count``; an
empty one has one empty field and fails likewise; the loader never raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted field with doubled quotes, or a field that does not begin with a quote.
#: Possessive, so that the matcher keeps no state for long fields.
FIELD = r'"(?:[^"]++|"")*+"|(?!")[^,]*+'
BLANKS = " \t\n\r\f"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


@dataclass(frozen=True)
class Rule:
    """``reason`` holds for a record where ``broken`` is true (null counts as true)."""

    reason: str
    broken: Column


def _once(c: Column) -> Column:
    """The same value by way of a generator: the optimiser does not copy the expression
    into each of its uses, so it is evaluated once a row."""
    return F.explode(F.array(c))


def parse(records: DataFrame, raw: str, fields: list[str]) -> DataFrame:
    """Adds ``_parts`` (the record's fields as text, null where quoting is broken)
    and one nullable text column per field, trimmed."""
    body = F.regexp_replace(F.col(raw), r"\r\z", "")
    sound = body.rlike(rf"\A(?:{FIELD})(?:,(?:{FIELD}))*+\z")
    parts = F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(f",({FIELD})"), F.lit(1))
    unquoted = F.transform(
        parts,
        lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p),
    )
    out = records.withColumn("_parts", _once(F.when(sound, unquoted)))
    return out.withColumns({f: trimmed(F.try_element_at("_parts", F.lit(i + 1))) for i, f in enumerate(fields)})


def with_errors(records: DataFrame, raw: str, fields: list[str], rules: list[Rule]) -> DataFrame:
    """Adds the fields and ``errors``: the reasons that hold, in the order of the rules.

    Broken quoting and a wrong number of fields leave nothing to test, so they
    stand alone."""
    parsed = parse(records, raw, fields)
    found = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(True)), F.lit(r.reason)) for r in rules]))
    errors = (
        F.when(F.col(raw).isNotNull() & F.col("_parts").isNull(), F.array(F.lit("quoting")))
        .when(F.coalesce(F.size("_parts"), F.lit(0)) != len(fields), F.array(F.lit("column_count")))
        .otherwise(found)
    )
    return parsed.withColumn("errors", _once(errors)).drop("_parts")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to load and the rows to reject (with ``reason``, the first error)."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0).withColumn("reason", F.element_at("errors", 1))


TIME_ENTRY_FIELDS = ["date", "timekeeper", "hours", "task_code", "activity_code", "narrative"]


def time_entry_rules() -> list[Rule]:
    """The rules for time entries."""

    def code(c: str) -> Rule:
        return Rule(c, ~F.col(c).rlike(r"\A(?:[A-Za-z][0-9]{3})?\z"))

    day = F.col("date")
    is_day = day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~F.startswith(day, F.lit("0000")) & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    hours = F.col("hours")
    return [
        Rule("date", ~is_day),
        Rule("timekeeper", (F.length("timekeeper") == 0) | (F.length("timekeeper") > 100)),
        Rule("hours", ~hours.rlike(r"\A0*(?:(?:1?[0-9]|2[0-3])(?:\.[0-9]+)?|24(?:\.0+)?)\z") | hours.rlike(r"\A[0.]*\z")),
        code("task_code"),
        code("activity_code"),
        Rule("narrative", F.length("narrative") == 0),
    ]


def time_entries(records: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Typed time entries and rejected records, from records of
    date, timekeeper, hours, task_code, activity_code, narrative.

    Codes are upper-cased, empty codes null, hours decimal(38, 18) rounded from the text."""
    good, bad = split(with_errors(records, raw, TIME_ENTRY_FIELDS, time_entry_rules()))
    typed = good.withColumns(
        {
            "date": F.to_date("date"),
            "hours": F.col("hours").cast("decimal(38,18)"),
            "task_code": F.upper(F.nullif(F.col("task_code"), F.lit(""))),
            "activity_code": F.upper(F.nullif(F.col("activity_code"), F.lit(""))),
        }
    )
    return typed, bad
