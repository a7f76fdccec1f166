"""Graph patterns as joins: triple patterns, OPTIONAL, UNION, EXISTS, VALUES, alternatives of predicates, CONSTRUCT.

Terms are strings as N-Triples writes them, but for IRIs without their brackets: `http://..`, `_:b`, `"text"`, `"text"@en`,
`"1"^^http://..`. So an IRI never equals a literal of the same letters, and joins are on whole terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.context import kept, weigh_files
from quadrille.operators.reshape import col

#: Public vocabularies that names are shortened by.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "qb": "http://purl.org/linked-data/cube#",
    "dct": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "qudt": "http://qudt.org/schema/qudt/",
    "scot": "http://statistics.gov.scot/def/dimension/",
}
#: Triples of a task that sorts and writes them.
TRIPLES = 500_000
Term = str | Sequence[str]
Triple = tuple[Term, Term, Term]


def iri(name: str) -> str:
    """`prefix:name` in full, if the prefix is known."""
    prefix, _, rest = name.partition(":")
    return PREFIXES[prefix] + rest if prefix in PREFIXES and not rest.startswith("//") else name


def _constant(name: str, place: str) -> str:
    """In full; as a predicate `a` is rdf:type."""
    return PREFIXES["rdf"] + "type" if place == "p" and name == "a" else iri(name)


def literal(text: str) -> str:
    return f'"{text}"'


def term(o: Column, is_literal: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """The term of an object as sources.tables.quads() gives it."""
    tail = F.lit("")
    for mark, c in (("^^", datatype), ("@", lang)):
        tail = tail if c is None else F.when(c.isNotNull(), F.concat(F.lit(mark), c)).otherwise(tail)
    return F.when(is_literal, F.concat(F.lit('"'), o, F.lit('"'), tail)).otherwise(o)


def text_of(c: Column) -> Column:
    """A term's letters: what is between a literal's quotes, or the IRI."""
    return F.when(c.startswith('"'), F.regexp_extract(c, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^[^"]*)?$', 1)).otherwise(c)


def _is_variable(t: Term) -> bool:
    return isinstance(t, str) and t.startswith("?")


def _same(a: DataFrame, b: DataFrame, names: Iterable[str], maybe: Iterable[str] = ()) -> Column | None:
    """Equal in the columns of these names; in those of `maybe`, equal or unbound on a side."""
    parts = [a[n] == b[n] for n in names] + [a[n].isNull() | b[n].isNull() | (a[n] == b[n]) for n in maybe]
    return reduce(lambda x, y: x & y, parts) if parts else None


@dataclass(frozen=True)
class Solutions:
    """Solutions of a pattern: a column for each variable, null where it is unbound. `bound` are those that never are."""

    rows: DataFrame
    bound: frozenset[str] = field(default_factory=frozenset)

    def _own(self) -> Solutions:
        """The same under columns of its own, so that it can be joined with what it came from."""
        return Solutions(self.rows.select(*(col(c).alias(c) for c in self.rows.columns)), self.bound)

    def _keys(self, other: Solutions) -> tuple[list[str], list[str]]:
        """Shared variables that are bound on both sides, and those that may not be."""
        shared = [c for c in self.rows.columns if c in other.rows.columns]
        sure = [c for c in shared if c in self.bound and c in other.bound]
        if not sure:
            raise ValueError(f"patterns share no variable that both always bind: {self.rows.columns}, {other.rows.columns}")
        return sure, [c for c in shared if c not in sure]

    def _merged(self, other: Solutions, how: str) -> Solutions:
        sure, maybe = self._keys(other)
        left, right = self.rows, other._own().rows
        both = left.join(right, _same(left, right, sure, maybe), how)
        value = lambda c: left[c] if c in sure else F.coalesce(left[c], right[c]) if c in maybe else both[c]
        names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
        return Solutions(both.select(*(value(c).alias(c) for c in names)), self.bound | other.bound if how == "inner" else self.bound)

    def join(self, other: Solutions) -> Solutions:
        return self._merged(other, "inner")

    def optional(self, other: Solutions, exists: Sequence[Solutions] = (), not_exists: Sequence[Solutions] = ()) -> Solutions:
        """With what `other` adds where it matches, and unbound where it doesn't. Conditions in `exists` and `not_exists` may
        speak of variables of both sides; they then decide which matches count."""
        if not exists and not not_exists:
            return self._merged(other, "left")
        needed = {c for x in (other, *exists, *not_exists) for c in x.rows.columns} & set(self.rows.columns)
        keys = [c for c in self.rows.columns if c in needed]
        matched = Solutions(self.rows.select(*map(col, keys)).distinct(), self.bound & set(keys)).join(other)
        for x in exists:
            matched = matched.exists(x)
        for x in not_exists:
            matched = matched.not_exists(x)
        left, right = self.rows, matched._own().rows
        on = reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) if c not in self.bound else left[c] == right[c] for c in keys))
        return Solutions(left.join(right, on, "left").select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in left.columns)), self.bound)

    def _filtered(self, other: Solutions, how: str) -> Solutions:
        sure, maybe = self._keys(other)
        right = Solutions(other.rows.select(*map(col, sure + maybe)).distinct(), other.bound)._own().rows
        return Solutions(self.rows.join(right, _same(self.rows, right, sure, maybe), how), self.bound)

    def exists(self, other: Solutions) -> Solutions:
        return self._filtered(other, "left_semi")

    def not_exists(self, other: Solutions) -> Solutions:
        return self._filtered(other, "left_anti")

    def values(self, variable: str, terms: Iterable[str]) -> Solutions:
        """Only solutions with one of the terms; a variable that isn't there yet takes each of them."""
        name, wanted = variable.lstrip("?"), [iri(t) for t in terms]
        if name in self.rows.columns:
            return Solutions(self.rows.where(col(name).isin(wanted)), self.bound | {name})
        return Solutions(self.rows.withColumn(name, F.explode(F.array(*map(F.lit, wanted)).cast("array<string>"))), self.bound | {name})

    def where(self, condition: Column) -> Solutions:
        """An unbound variable makes a condition null, and the solution goes."""
        return Solutions(self.rows.where(condition), self.bound)

    def union(self, other: Solutions) -> Solutions:
        return Solutions(self.rows.unionByName(other.rows, allowMissingColumns=True), self.bound & other.bound)

    def select(self, *variables: str, distinct: bool = True) -> Solutions:
        names = [v.lstrip("?") for v in variables]
        rows = self.rows.select(*map(col, names))
        return Solutions(rows.distinct() if distinct else rows, self.bound & set(names))

    def construct(self, *templates: Triple) -> DataFrame:
        """(s, p, o) of the templates for each solution, once each; those with an unbound variable, or with a literal in
        another place than the object's, are left out."""
        value = lambda t, place: col(t[1:]) if _is_variable(t) else F.lit(_constant(t, place))
        made = F.array(*(F.struct(*(value(t, n).alias(n) for t, n in zip(x, "spo", strict=True))) for x in templates))
        out = self.rows.select(F.explode(made).alias("t")).select("t.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
        return out.where(~F.col("s").startswith('"') & ~F.col("p").startswith('"')).distinct()


@dataclass(frozen=True)
class Graph:
    """Triples (s, p, o) of terms, each once, and how many each predicate has, if that is known."""

    triples: DataFrame
    counts: dict[str, int] | None = None

    @staticmethod
    def of(quads: DataFrame, graphs: Iterable[str] | None = None) -> Graph:
        """The union of named graphs, or of some; quads are (s, p, o, g, o_is_literal, o_datatype, o_lang)."""
        rows = quads if graphs is None else quads.where(F.col("g").isin(list(graphs)))
        return Graph(rows.select("s", "p", term(F.col("o"), F.col("o_is_literal"), F.col("o_datatype"), F.col("o_lang")).alias("o")).repartition("s", "p", "o").distinct())  # dealt first: a task that reads much would hold all that it reads

    def write(self, path: str) -> Graph:
        """Laid out by predicate, so that a pattern reads the files of its predicates only, and within one by ranges of
        subjects and objects, so that a predicate that holds much of the graph, or a subject that does, is many files and
        tasks, of some TRIPLES each. Predicates, which are a vocabulary, are counted once."""
        whole = kept(self.triples.select("s", "p", "o"), "triples")
        whole.repartitionByRange(max(1, -(-whole.count() // TRIPLES)), "p", "s", "o").sortWithinPartitions("p", "s").write.mode("overwrite").partitionBy("p").parquet(path)
        return Graph.read(self.triples.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        weigh_files(spark)
        rows = spark.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o")
        return Graph(rows, dict(rows.groupBy("p").count().collect()))

    def _one(self, triple: Triple) -> Solutions:
        """One triple pattern: constants are filters, and variables columns; a sequence of constants is any of them."""
        rows, names = self.triples, {}
        for t, c in zip(triple, "spo", strict=True):
            if _is_variable(t):
                names.setdefault(t[1:], []).append(c)
            else:
                rows = rows.where(F.col(c).isin([_constant(x, c) for x in ([t] if isinstance(t, str) else t)]))
        for same in names.values():
            for c in same[1:]:
                rows = rows.where(F.col(same[0]) == F.col(c))
        found = rows.select(*(F.col(c[0]).alias(n) for n, c in names.items()))
        return Solutions(found, frozenset(names))

    def _size(self, triple: Triple) -> float:
        """About how many rows a pattern has: those of its predicates, fewer with other constants."""
        p = triple[1]
        all_of = sum(self.counts.values())
        n = all_of if _is_variable(p) else sum(self.counts.get(_constant(x, "p"), 0) for x in ([p] if isinstance(p, str) else p))
        return n / 100 ** sum(not _is_variable(t) for t in (triple[0], triple[2]))

    def match(self, *triples: Triple) -> Solutions:
        """Solutions of all triple patterns together. If the predicates' counts are known, the smallest pattern comes first,
        and then always the smallest that shares a variable with those before; else they are joined as they are given."""
        if not triples:
            raise ValueError("a pattern needs a triple")
        todo, order, seen = list(triples), [], set()
        of = lambda t: {x for x in t if _is_variable(x)}
        while todo:
            linked = [t for t in todo if not order or of(t) & seen]
            if not linked:
                raise ValueError(f"{todo[0]} shares no variable with the patterns before it")
            best = min(linked, key=self._size) if self.counts is not None else linked[0]
            todo.remove(best)
            order.append(best)
            seen |= of(best)
        return reduce(lambda a, b: a.join(b), map(self._one, order))

    def updated(self, deleted: DataFrame, inserted: DataFrame) -> Graph:
        """Without the deleted triples (s, p, o), with the inserted."""
        rows = self.triples.select("s", "p", "o")
        return Graph(rows.join(deleted.select("s", "p", "o"), ["s", "p", "o"], "left_anti").union(inserted.select("s", "p", "o")).distinct())
