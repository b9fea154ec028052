"""Patterns as SQL text over tables v(id, label) and e(src, dst, src_label, dst_label)."""

from __future__ import annotations

from collections.abc import Sequence

from ..model import Pattern


def _quoted(label: str) -> str:
    return "'" + label.replace("'", "''") + "'"


def joins(pattern: Pattern, semantics: str = "iso") -> tuple[str, str, dict[int, str]]:
    """Common table expressions of the relations, FROM and WHERE of all matches, and the column of each vertex.

    Relations are materialized, so that a planner knows their sizes.
    """
    tables, where, home = [], [], {}
    for i, (u, v) in enumerate(pattern.edges):
        tables.append(f"r{i} AS MATERIALIZED (SELECT src, dst FROM e WHERE src_label = {_quoted(pattern.labels[u])} AND dst_label = {_quoted(pattern.labels[v])})")
        for x, c in ((u, f"r{i}.src"), (v, f"r{i}.dst")):
            if x in home:
                where.append(f"{home[x]} = {c}")
            else:
                home[x] = c
    if semantics == "iso":
        where += [f"{home[a]} <> {home[b]}" for a in range(len(pattern)) for b in range(a) if pattern.same_label(a, b)]
    names = ", ".join(f"r{i}" for i in range(len(pattern.edges)))
    return ", ".join(tables), f"FROM {names}" + (f" WHERE {' AND '.join(where)}" if where else ""), home


def rows_select(pattern: Pattern, semantics: str = "iso", columns: Sequence[int] | None = None) -> tuple[str, str]:
    """The common table expressions and the query over them."""
    tables, text, home = joins(pattern, semantics)
    chosen = range(len(pattern)) if columns is None else columns
    return tables, f"SELECT {', '.join(f'{home[u]} AS u{u}' for u in chosen)} {text}"


def rows_sql(pattern: Pattern, semantics: str = "iso", columns: Sequence[int] | None = None) -> str:
    return ", {} {}".format(*rows_select(pattern, semantics, columns))


def count_sql(pattern: Pattern, semantics: str = "iso", limit: int | None = None) -> str:
    tables, text, _ = joins(pattern, semantics)
    n = "count(*)" if limit is None else f"least(count(*), {limit})"
    return f", {tables} SELECT CAST({n} AS BIGINT) AS n {text}"


def star_sql(center: str, leaf: str, leaves: int, semantics: str = "iso") -> str:
    """A star of equal leaves in factored form."""
    ways = " * ".join(f"(d - {i})" if semantics == "iso" and i else "d" for i in range(leaves))
    return f"SELECT CAST(coalesce(sum({ways}), 0) AS BIGINT) AS n FROM (SELECT src, CAST(count(*) AS HUGEINT) AS d FROM e WHERE src_label = {_quoted(center)} AND dst_label = {_quoted(leaf)} GROUP BY src)"
