"""Markdown text of results; DataFrames are the interface, this is for reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(rows: DataFrame, title: str, most: int = 100) -> str:
    """A heading and a table of the first `most` rows, with a line about more."""
    got = rows.limit(most + 1).collect()
    if not got:
        return f"## {title}\n\nNo results.\n"
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in got[:most]]
    return "\n".join([*lines, *(["", f"More than {most} rows."] if len(got) > most else [])]) + "\n"
