"""Results as text (SK1-SK5, SK10): TOON, Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import toon

FORMATS = ("toon", "md", "json")


def chosen_format(name: str = "toon", md: bool = False, json: bool = False) -> str:
    """SK5: the format that was asked for; two different ones are a ValueError."""
    asked = {n for n, on in (("md", md), ("json", json)) if on} | ({name} if name != "toon" else set())
    if len(asked) > 1 or not asked <= set(FORMATS):
        raise ValueError(f"conflicting or unknown formats: {', '.join(sorted(asked))}")
    return asked.pop() if asked else "toon"


def _cell(df: DataFrame, column: str):
    c = F.col(column)
    return F.array_join(c.cast("array<string>"), " ") if df.schema[column].dataType.typeName() == "array" else c.cast("string")


def line_of(df: DataFrame, columns: list[str], form: str) -> Column:
    """SK2-SK4: a row as an indented line of comma-separated scalars, as a line of a table, or as a JSON object (nothing is escaped for HTML)."""
    if form == "json":
        return F.to_json(F.struct(*columns))
    if form == "md":
        cells = [F.replace(F.coalesce(_cell(df, c), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return F.concat(F.lit("  "), F.concat_ws(",", *[F.coalesce(toon(_cell(df, c)), F.lit('""')) for c in columns]))


def toon_rows(df: DataFrame) -> DataFrame:
    """SK2."""
    return df.select(line_of(df, df.columns, "toon").alias("line"))


def toon_header(name: str, columns: list[str], n: int) -> str:
    """SK2."""
    return f"{name}[{n}]{{{','.join(columns)}}}:"


def markdown_rows(df: DataFrame) -> DataFrame:
    """SK3."""
    return df.select(line_of(df, df.columns, "md").alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    """SK4."""
    return df.select(line_of(df, df.columns, "json").alias("line"))


def render(df: DataFrame, name: str, form: str = "toon", most: int = 1000) -> str:
    """A view as text on the driver: at most `most` rows, then how many more there are (SK10). JSON isn't cut."""
    rows = {"toon": toon_rows, "md": markdown_rows, "json": json_rows}[form](df)
    if form == "json":
        return "[\n" + ",\n".join("  " + r["line"] for r in rows.toLocalIterator()) + "\n]\n"
    n = df.count()
    lines = [r["line"] for r in rows.limit(most).collect()]
    head = [toon_header(name, df.columns, n)] if form == "toon" else ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    more = [f"# +{n - most} more"] if n > most else []
    return "\n".join([*head, *lines, *more]) + "\n"


def append_log(df: DataFrame, folder: str) -> None:
    """SK1: rows appended to a log folder as lines of JSON."""
    df.write.mode("append").option("ignoreNullFields", "true").json(folder)
