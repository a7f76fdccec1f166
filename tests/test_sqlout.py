"""SQL texts of expressions, run by Spark and by DuckDB, against the plans of the same expressions."""

import duckdb
import pytest

from quadrille.operators.reshape import members
from quadrille.plans import sqlout, sqltext
from quadrille.plans.compiler import CubeContext, compile

ROWS = [(f"p{i % 5}", f"r{i % 3}" if i % 11 else None, f"it's {i % 2}", float(i) if i % 7 else None, float(i * 3 % 17), i % 4) for i in range(120)]
SCHEMA = 'period string, region string, `kind of it` string, a double, b double, c int'
T = '(VALUE T (MSR ({})) (DIM period ({})) (DIM region ({})))'
PROGRAMS = [
    ("pivoted", T.format("a b", "p1 p2", "r0 r2")),
    ("pivoted", T.format("a", "p1", "")),
    ("pivoted", "(VALUE T (MSR (a)))"),
    ("pivoted", "(VALUE T (MSR (a > 40)) (DIM period (p1 p2)))"),
    ("pivoted", '(VALUE T (MSR (a c)) (DIM "kind of it" ("it\'s 0" "it\'s 1" nowhere)))'),
    ("simplified", T.format("a b", "p1", "")),
    ("simplified", "(VALUE T (MSR (b <= 3)) (DIM region ()))"),
    *((m, f"({f} (period) {T.format('a b', 'p1 p2', 'r0 r1')})") for m in ("pivoted", "simplified") for f in ("SUM", "AVG", "MIN", "MAX")),
    *((m, f"({f} () {T.format('a b', 'p1 p2', 'r0 r1')})") for m in ("pivoted", "simplified") for f in ("SUM", "MAX")),
    ("pivoted", "(SUM (period) (VALUE T (MSR (a b)) (DIM period (p1 p2))))"),
    ("pivoted", f"(PROP (DIM region (r1 r2)) {T.format('a b', 'p1 p2', '')})"),
    ("pivoted", f"(JOIN (period) {T.format('a', 'p1 p2', 'r0')} {T.format('b', 'p2 p3', 'r0')})"),
    ("pivoted", f"(JOIN (period) {T.format('a b', 'p1 p2', 'r0')} {T.format('a b', 'p2 p3', 'r0')} {T.format('c', 'p4', 'r1')})"),
    ("pivoted", f"(JOIN (period region) {T.format('a', 'p1 p2', 'r0 r1')} {T.format('b', 'p2', 'r1 r2')})"),
    ("pivoted", f"(JOIN (a) {T.format('a', 'p1', 'r0')} {T.format('a', 'p2', 'r0')})"),
    ("pivoted", f"(SUM () (JOIN (a) {T.format('a', 'p1', 'r0')} {T.format('a', 'p2', 'r0')}))"),
    ("simplified", f"(JOIN (period) {T.format('a', 'p1 p2', 'r0')} {T.format('b c', 'p2 p3', 'r0 r1')})"),
    ("simplified", f"(AVG () (JOIN (a) {T.format('a', 'p1 p2', 'r0')} {T.format('a b', 'p2', 'r0')}))"),
]


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: f"{v:.9g}" if isinstance(v, (int, float)) else str(v)
    return [columns[i] for i in order], sorted([value(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def cubes(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"{tmp_path_factory.mktemp('cubes')}/T.parquet"
    df.repartition(3).write.parquet(path)
    return df, path


@pytest.mark.parametrize(("mode", "program"), PROGRAMS)
def test_texts_say_what_plans_do(spark, cubes, mode, program):
    df, path = cubes
    plan = compile(program, CubeContext(spark, cubes={"T": df}), mode)
    want = shown(plan.columns, plan.collect())
    told = lambda table, group: members(df, group)
    duck = duckdb.sql(sqlout.to_sql(program, lambda _: f"'{path}/*.parquet'", mode, told))
    assert shown(duck.columns, duck.fetchall()) == want
    own = sqltext.run(spark, sqlout.to_sql(program, lambda _: f"'{path}'", mode, told))
    assert shown(own.columns, own.collect()) == want


def test_texts_need_members_and_modes():
    with pytest.raises(ValueError, match="no codes"):
        sqlout.to_sql(T.format("a", "", "r0"), lambda t: t)
    with pytest.raises(ValueError, match="mode"):
        sqlout.to_sql(T.format("a", "p1", "r0"), lambda t: t, "native")


def test_columns_by_their_schema(spark, cubes):
    """In a subquery, over a file, and nested; quotes in names; none that fits is an error."""
    _, path = cubes
    sql = f"SELECT name, COUNT(*) AS n FROM (SELECT a, b AS \"it's b\", c + 0.0 AS c, region AS Measure FROM '{path}') UNPIVOT (Value FOR name IN (COLUMNS(c -> NOT contains(c, 'Measure')))) GROUP BY name"
    assert {r.name: r.n for r in sqltext.run(spark, sql).collect()} == {"a": 102, "it's b": 120, "c": 120}
    nested = f"SELECT * FROM (SELECT name, SUM(v) AS total FROM (SELECT a, b FROM '{path}') UNPIVOT (v FOR name IN (COLUMNS(x -> x <> 'b'))) GROUP BY name) UNPIVOT (w FOR m IN (COLUMNS(x -> x = 'total')))"
    assert [(r.name, r.m) for r in sqltext.run(spark, nested).collect()] == [("a", "total")]
    with pytest.raises(ValueError, match="COLUMNS"):
        sqltext.run(spark, sql.replace("NOT contains(c, 'Measure')", "c = 'x'"))
    assert sqltext.outcome(spark, sql.replace("NOT contains(c, 'Measure')", "c = 'x'")).startswith("runtime")
