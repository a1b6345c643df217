"""Reports of one row as JSON, Markdown and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def to_json(df: DataFrame) -> DataFrame:
    """(json): each row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def markdown(row: Row) -> str:
    """A two-column table; the bootstrap bounds are P10 and P90, an 80 % interval."""
    return "\n".join(["| field | value |", "|---|---|", *[f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.asDict().items()]])


def page(row: Row, title: str = "Migration gate") -> str:
    """A self-contained HTML page."""
    cells = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</td></tr>" for k, v in row.asDict().items())
    colour = {"PASS": "#1a7f37", "WARN": "#9a6700", "FAIL": "#cf222e"}.get(row.asDict().get("verdict"), "#57606a")
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><h1 style="color:{colour}">{html.escape(title)}: {html.escape(str(row.asDict().get("verdict", "")))}</h1><table>{cells}</table></html>'


def exit_code(row: Row) -> int:
    """0 for PASS only."""
    return int(row["verdict"] != "PASS")


def between_markers(text: str, start: str, end: str, body: str) -> str:
    """``text`` with what lies between two marker lines replaced."""
    head, found, rest = text.partition(start)
    if not found or end not in rest:
        raise ValueError("the markers aren't there")
    return f"{head}{start}\n{body}\n{end}{rest.partition(end)[2]}"
