"""SQL text of cube expressions, for readers and for engines of the dialect that sqltext.to_spark() reads.

The texts say what compile() plans in its modes `pivoted` and `simplified`, with conditional aggregates where these pivot, so
that names of columns are known and any engine with UNPIVOT runs them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from quadrille.plans.expressions import Aggregate, Join, Node, Proportion, Value, read

#: What stands after FROM for a table, and the codes of a dimension of one whose list is empty.
Relation = Callable[[str], str]
Members = Callable[[str, str], Iterable[str]]


def name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _names(names: Iterable[str]) -> str:
    return ", ".join(map(name, names))


class Writer:
    """Writes the parts of one text."""

    def __init__(self, relation: Relation, members: Members | None = None) -> None:
        self.relation, self._members = relation, members

    def codes(self, v: Value, group: str) -> list[str]:
        found = list(v.codes(group))
        if not found and self._members is None:
            raise ValueError(f"{group} has no codes, and nothing tells its members")
        return found or list(self._members(v.table, group))

    def where(self, v: Value) -> str:
        parts = [f"{name(g)} = {text(c[0])}" if len(c) == 1 else f"{name(g)} IN ({', '.join(map(text, c))})" for g, c in v.dims if c]
        parts += [f"{name(v.measures[0])} {v.compare[0]} {v.compare[1]!r}"] if v.compare else []
        return " WHERE " + " AND ".join(parts) if parts else ""

    def selected(self, v: Value) -> str:
        return f"SELECT {_names([*v.groups, *(m for m in v.measures if m not in v.groups)])} FROM {self.relation(v.table)}{self.where(v)}"

    def long(self, v: Value) -> str:
        columns = ", ".join([*map(name, v.groups), *(f"CAST({name(m)} AS DOUBLE) AS {name(m)}" for m in v.measures)])
        return f'SELECT * FROM (SELECT {columns} FROM {self.relation(v.table)}{self.where(v)}) UNPIVOT ("Value" FOR "Measure" IN ({_names(v.measures)}))'

    def pivoted(self, v: Value, index: list[str], keys: list[tuple[str, list[str]]], function: str = "MAX") -> tuple[str, list[str]]:
        """A text with a row for each index and a column for each combination of codes, and the columns' names."""
        cells, names = [], []
        for combination in product(*(codes for _, codes in keys)):
            hit = " AND ".join(f"{name(g)} = {text(c)}" for (g, _), c in zip(keys, combination, strict=True))
            names.append("_".join(combination) or "Value")
            cells.append(f'{function}(CASE WHEN {hit} THEN "Value" END) AS {name(names[-1])}' if hit else f'{function}("Value") AS "Value"')
        held = [f"{name(g)} IN ({', '.join(map(text, codes))})" for g, codes in keys]
        rows = self.long(v) if not held else f"SELECT * FROM ({self.long(v)}) WHERE {' AND '.join(held)}"
        by = f" GROUP BY {_names(index)}" if index else ""
        return f"SELECT {', '.join([*map(name, index), *cells])} FROM ({rows}){by}", names

    def keys(self, v: Value, without: Iterable[str] = ()) -> list[tuple[str, list[str]]]:
        return [(g, self.codes(v, g)) for g in v.groups if g not in set(without)]

    def aggregate(self, a: Aggregate, mode: str) -> str:
        v = a.inner
        if isinstance(v, Join):
            return self.aggregate_join(a, mode)
        if mode == "pivoted":
            if a.selector is None:
                found, _ = self.pivoted(v, [], self.keys(v), a.function)
                return f'SELECT *, {text(";".join(v.measures))} AS "Measure" FROM ({found})'
            keys = self.keys(v, [a.selector])
            return self.pivoted(v, ["Measure"], keys, a.function)[0] if keys else self.pivoted(v, [], [("Measure", list(v.measures))], a.function)[0]
        if a.function in ("SUM", "AVG"):
            by = f" GROUP BY {_names(v.groups)}" if v.groups else ""
            return f'SELECT {", ".join([*map(name, v.groups), ""])}{a.function}({" + ".join(map(name, v.measures))}) AS "Value" FROM ({self.selected(v)}){by}'
        best = f'(SELECT {a.function}("Value") FROM ({self.long(v)}))'
        if a.selector:
            shown = f'{name(a.selector)} AS {name(f"{a.function}[{a.selector}]")}, "Measure", "Value"'
        else:
            shown = ", ".join(['"Measure"', *map(name, v.groups), f'"Value" AS {name(f"{a.function}[Value]")}'])
        return f'SELECT {shown} FROM ({self.long(v)}) WHERE "Value" = {best}'

    def aligned(self, parts: list[tuple[str, list[str]]], keys: list[str]) -> str:
        """Full outer joins of (text, other columns) on keys, each the first that isn't null."""
        out, columns = parts[0]
        for other, more in parts[1:]:
            on = " AND ".join(f"a.{name(k)} = b.{name(k)}" for k in keys)
            shown = [*(f"COALESCE(a.{name(k)}, b.{name(k)}) AS {name(k)}" for k in keys), *(f"a.{name(c)}" for c in columns), *(f"b.{name(c)}" for c in more)]
            out, columns = f"SELECT {', '.join(shown)} FROM ({out}) a FULL JOIN ({other}) b ON {on}", [*columns, *more]
        return out

    def join(self, j: Join, mode: str) -> tuple[str, list[str]]:
        """The text, and the names of its columns but for those of the rows."""
        if mode == "simplified":
            keys = [g for g in j.inputs[0].groups if all(g in v.groups for v in j.inputs)]
            if not any(s in keys for s in j.selectors):
                keys += [m for m in j.inputs[0].measures if m in j.selectors and all(m in v.measures for v in j.inputs)]
            tables = [(self.selected(v), [c for c in dict.fromkeys((*v.groups, *v.measures)) if c not in keys]) for v in j.inputs]
            parts, names = self.renamed(tables, keys)
            return self.aligned(parts, keys), names
        of_measure = not all(s in v.groups for s in j.selectors for v in j.inputs)
        axis = ["Measure"] if of_measure else list(j.selectors)
        tables = []
        for v in j.inputs:
            keys = self.keys(v, () if of_measure else axis)
            if not of_measure and (not keys or len(v.measures) > 1):
                keys = [("Measure", list(v.measures)), *keys]
            tables.append(self.pivoted(v, axis, keys))
        parts, names = self.renamed(tables, axis)
        if of_measure:
            return self.aligned(parts, axis), names
        first, columns = parts[0]
        parts[0] = f'SELECT *, 1 AS "_first" FROM ({first})', [*columns, "_first"]
        key = f"CONCAT_WS(', ', {_names(axis)})" if len(axis) > 1 else name(axis[0])
        otherwise = " ELSE ''" if len(axis) > 1 else ""
        return f'SELECT CASE WHEN "_first" = 1 THEN {key}{otherwise} END AS "Measure", {_names(names)} FROM ({self.aligned(parts, axis)})', names

    def renamed(self, tables: list[tuple[str, list[str]]], keys: list[str]) -> tuple[list[tuple[str, list[str]]], list[str]]:
        """Columns that an input before has get the input's number."""
        taken, parts, every = set(keys), [], []
        for i, (table, columns) in enumerate(tables):
            names = {c: c if c not in taken else f"{c}_{i}" for c in columns}
            taken |= set(names.values())
            every += names.values()
            shown = [*map(name, keys), *(f"{name(c)} AS {name(n)}" if c != n else name(c) for c, n in names.items())]
            parts.append((f"SELECT {', '.join(shown)} FROM ({table})", list(names.values())))
        return parts, every

    def aggregate_join(self, a: Aggregate, mode: str) -> str:
        j = a.inner
        found, names = self.join(j, mode)
        if mode == "simplified":
            measure = next((s for s in j.selectors if all(s in v.measures for v in j.inputs)), j.inputs[0].measures[0])
            return f'SELECT {text(measure)} AS "Measure", {a.function}({name(measure)}) AS "Value" FROM ({found})'
        cells = [c for c in names if "Measure" not in c]
        return f'SELECT "Measure", {a.function}("Value") AS "Value" FROM ({found}) UNPIVOT ("Value" FOR "name" IN ({_names(cells)})) GROUP BY "Measure"'

    def proportion(self, p: Proportion) -> str:
        rest = _names([*sorted(g for g in p.inner.groups if g != p.group), "Measure"])
        part = f'SUM(CASE WHEN {name(p.group)} IN ({", ".join(map(text, p.selected))}) THEN "Value" ELSE 0 END)'
        total = 'SUM("Value")'
        shown = f'{total} AS {name(f"SUM[{p.group}]")}, {part} AS {name("_".join(p.selected))}, ROUND({part} * CAST(100 AS DOUBLE) / NULLIF({total}, 0), 2) AS "%"'
        return f'SELECT "Measure", {_names([f"SUM[{p.group}]", "_".join(p.selected), "%"])} FROM (SELECT CONCAT_WS(\', \', {rest}) AS "Measure", {shown} FROM ({self.long(p.inner)}) GROUP BY CONCAT_WS(\', \', {rest}))'


def to_sql(node: Node | str, relation: Relation, mode: str = "pivoted", members: Members | None = None) -> str:
    """The text of an expression in one of the two modes that have one. `relation` gives what stands after FROM, such as a
    Parquet file in quotes; `members` a dimension's codes where a pivot needs them and the expression names none."""
    if mode not in ("pivoted", "simplified"):
        raise ValueError("mode must be pivoted or simplified")
    node, writer = read(node) if isinstance(node, str) else node, Writer(relation, members)
    match node:
        case Value():
            return writer.selected(node) if mode == "simplified" else writer.pivoted(node, ["Measure"], writer.keys(node))[0]
        case Join():
            return writer.join(node, mode)[0]
        case Aggregate():
            return writer.aggregate(node, mode)
        case Proportion():
            return writer.proportion(node)
    raise TypeError(node)
