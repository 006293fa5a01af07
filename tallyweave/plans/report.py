"""Standalone HTML reports from small results; every value is escaped."""

from __future__ import annotations

from html import escape

_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.cards{display:flex;gap:1em}.card{border:1px solid #ccc;padding:1em}"


def human_bytes(n: float) -> str:
    """A size with two decimals in the largest fitting unit."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.2f} {unit}"
        n /= 1024
    return ""


def human_number(n: float) -> str:
    return f"{n:,}"


def table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def page(title: str, cards: dict[str, object], sections: list[tuple[str, str]]) -> str:
    shown = "".join(f'<div class="card"><b>{escape(str(v))}</b><br>{escape(k)}</div>' for k, v in cards.items())
    body = "".join(f"<h2>{escape(t)}</h2>{html}" for t, html in sections)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1><div class="cards">{shown}</div>{body}</body></html>'


def profile_html(profile: dict, title: str = "Profile") -> str:
    """The report of a table's profile."""
    columns, numbers, words = [], [], []
    for c in profile["column_stats"]:
        columns.append([c["name"], c["type"], human_number(c["missing_count"]), f"{c['missing_pct']:.2f}%", human_number(c["distinct_count"]), f"{c['cardinality_pct']:.2f}%"])
        if s := c["numeric_stats"]:
            numbers.append([c["name"], *(s[k] for k in ("min", "max", "mean", "std", "median", "p25", "p75"))])
        words += [[c["name"], t["value"], human_number(t["count"]), f"{t['pct']}%"] for t in c["top_categories"] or ()]
    preview = [[r.get(n) for n in profile["column_names"]] for r in profile["sample_records"]]
    sections = [
        ("Columns", table(["Column", "Type", "Missing", "Missing %", "Distinct", "Cardinality"], columns)),
        ("Numbers", table(["Column", "Min", "Max", "Mean", "Std", "Median", "P25", "P75"], numbers)),
        ("Most frequent values", table(["Column", "Value", "Count", "%"], words)),
        ("Preview", table(profile["column_names"], preview)),
    ]
    return page(title, {"rows": human_number(profile["total_rows"]), "columns": profile["total_cols"], "cells missing": f"{profile['total_missing_pct']}%"}, sections)


def eda_html(summary: dict[str, list[dict]], cards: dict[str, object], title: str = "Exploration") -> str:
    """A report with a table for each named list of rows."""
    return page(title, cards, [(name, table(list(rows[0]) if rows else [], [list(r.values()) for r in rows])) for name, rows in summary.items()])


def write(html: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(html)
