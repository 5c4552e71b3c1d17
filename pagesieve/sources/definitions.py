"""Definition files: reading, defaults and validation as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.definitions import STRATEGIES, Phrase, TableRule, defaults
from pagesieve.functions.text import strip
from pagesieve.schemas import DEFINITION_FILE

TABLE_DEFAULTS, ELEMENT_DEFAULTS = defaults(TableRule), defaults(Phrase)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """One row per table of the JSON definition file(s)."""
    return definition_rows(spark.read.schema(DEFINITION_FILE).option("multiLine", True).json(path))


def parse_definitions(rows: DataFrame, column: str) -> DataFrame:
    """The same from JSON texts in a column; the other columns are kept."""
    kept = [c for c in rows.columns if c != column]
    parsed = rows.select(*kept, F.from_json(column, DEFINITION_FILE).alias("file"))
    return definition_rows(parsed.select(*kept, "file.*"))


def definition_rows(files: DataFrame) -> DataFrame:
    kept = [c for c in files.columns if c not in ("description", "tables")]
    tables = files.select(*kept, F.posexplode("tables").alias("table_idx", "t")).select(
        *kept, "table_idx", "t.*"
    )

    def with_defaults(e: Column) -> Column:
        for field, value in ELEMENT_DEFAULTS.items():
            e = e.withField(field, F.coalesce(e[field], F.lit(value)))
        return e

    elements = F.coalesce(F.transform("text_elements", with_defaults), F.array())
    defaults = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in TABLE_DEFAULTS.items()}
    return tables.withColumns({**defaults, "text_elements": elements})


def definition_elements(definitions: DataFrame) -> DataFrame:
    """One row per phrase with the rule of its table."""
    return definitions.select(
        "name", "match_strategy", "min_elements", "min_percentage", "min_score",
        F.posexplode("text_elements").alias("elem_idx", "e"),
    ).select("name", "match_strategy", "min_elements", "min_percentage", "min_score", "elem_idx", "e.*")


def outside_unit(value: Column) -> Column:
    return (value < 0) | (value > 1)


def with_violations(definitions: DataFrame) -> DataFrame:
    """Add ``violations``: the names of the rules a definition breaks, empty if it is valid."""

    def any_element(test):
        return F.exists("text_elements", test)

    total = F.size("text_elements")
    rules = {
        "blank search_text": any_element(lambda e: strip(F.coalesce(e["search_text"], F.lit(""))) == ""),
        "negative max_errors": any_element(lambda e: e["max_errors"] < 0),
        "max_error_rate out of range": any_element(lambda e: outside_unit(e["max_error_rate"])),
        "weight not positive": any_element(lambda e: e["weight"] <= 0),
        "no elements": total == 0,
        "unknown match_strategy": ~F.col("match_strategy").isin(*STRATEGIES),
        "min_elements below 1": F.col("min_elements") < 1,
        "min_elements above number of elements":
            (F.col("match_strategy") == "min_count") & (F.col("min_elements") > total) & (total > 0),
        "min_percentage out of range": outside_unit(F.col("min_percentage")),
        "min_score out of range": outside_unit(F.col("min_score")),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return definitions.withColumn("violations", broken)


def valid_definitions(definitions: DataFrame) -> DataFrame:
    return with_violations(definitions).filter(F.size("violations") == 0).drop("violations")


def require_valid(definitions: DataFrame) -> DataFrame:
    """Fails the query at the first invalid definition."""
    checked = with_violations(definitions)
    message = F.concat(F.col("name"), F.lit(": "), F.array_join("violations", ", "))
    verdict = F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    return checked.filter(verdict).drop("violations")
