import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.plans.compiler import CubeContext, compile
from quadrille.plans.expressions import Aggregate, BracketError, ExpressionError, Join, Proportion, Value, parse, read, write
from quadrille.units import UnitCompatibilityError

UNITS = [
    ("D004645", "COUNT", "x 1 000", 1000.0, None, False),
    ("D006211_2", "COUNT", "x mln", 1000000.0, None, False),
    ("M005005_1", "COUNT", "x 1 000", 1000.0, None, False),
    ("M005005_2", "PERCENT", "%", None, None, True),
    ("M004367", "KILOGM-PER-KILOM", "mln tonkm", None, None, False),
    ("M004369", "TONNE", "ton", None, None, False),
    ("M001339", "EUR", "euro", None, None, False),
    ("M001860", "EUR", "euro", None, None, False),
]


@pytest.fixture(scope="module")
def cubes(spark):
    rows = [
        ("T001047", "2021JJ00", 31685.0, 205.2, None, 446.0, 973.0),
        ("T001047", "2022JJ00", 35933.0, 265.4, None, 571.0, 1401.0),
        ("L008691", "2021JJ00", 21440.0, None, 8957.0, None, None),
        ("L008691", "2022JJ00", 16498.0, None, 7792.0, None, None),
        ("L999996", "2021JJ00", 10245.0, None, 6498.0, None, None),
        ("L999996", "2022JJ00", 19436.0, None, 9172.0, None, None),
    ]
    holidays = spark.createDataFrame(rows, "Seizoen string, Perioden string, D004645 double, D006211_2 double, M005005_1 double, M001339 double, M001860 double")
    freight = spark.createDataFrame([("A045747", f"{y}JJ00", v) for y, v in ((2016, 19379.0), (2017, 17946.0), (2021, 11003.0), (2022, 9659.0))], "Vervoer string, Perioden string, M004367 double")
    units = spark.createDataFrame(UNITS, "node_id string, unit string, unit_string string, multiplier double, scaling_of string, is_dimensionless boolean")
    return CubeContext(spark, cubes={"85302NED": holidays, "84957NED": freight}, units=units)


H = "(VALUE 85302NED (MSR (D004645)) (DIM Seizoen (T001047)) (DIM Perioden (2021JJ00 2022JJ00)))"
BOTH = "(VALUE 85302NED (MSR (D004645 M005005_1)) (DIM Seizoen (L008691 L999996)) (DIM Perioden (2021JJ00 2022JJ00)))"
F1 = "(VALUE 84957NED (MSR (M004367)) (DIM Vervoer (A045747)) (DIM Perioden ({})))"


def numbers(df):
    return sorted(x for r in df.collect() for x in r if isinstance(x, float))


def test_value_in_all_modes(cubes):
    for mode in ("pivoted", "simplified", "native", "long"):
        assert numbers(compile(H, cubes, mode)) == [31685, 35933]
    assert set(compile(H, cubes).columns) == {"Measure", "T001047_2021JJ00", "T001047_2022JJ00"}


def test_comparison(cubes):
    text = "(VALUE 85302NED (MSR (D004645 < 35000)) (DIM Seizoen (T001047)) (DIM Perioden (2021JJ00 2022JJ00)))"
    assert numbers(compile(text, cubes)) == [31685]


def test_sum_over_periods(cubes):
    got = {r["Measure"]: (r["L008691"], r["L999996"]) for r in compile(f"(SUM (Perioden) {BOTH})", cubes).collect()}
    assert got == {"D004645": (37938, 29681), "M005005_1": (16749, 15670)}
    assert numbers(compile(f"(SUM (Perioden) {BOTH})", cubes, "simplified")) == [16743, 24290, 28608, 30397]


def test_sum_over_measures_equals_sum_of_cells(cubes):
    per_measure = sum(numbers(compile(f"(SUM (Perioden) {BOTH})", cubes)))
    assert sum(numbers(compile(f"(SUM () {BOTH})", cubes))) == per_measure
    assert compile(f"(SUM () {BOTH})", cubes).first()["Measure"] == "D004645;M005005_1"


def test_average(cubes):
    for mode in ("pivoted", "native"):
        assert numbers(compile(f"(AVG (Perioden) {H})", cubes, mode)) == [33809]
    assert numbers(compile(f"(AVG (Perioden) {H})", cubes, "simplified")) == [31685, 35933]


def test_extremes(cubes):
    best = compile(f"(MAX (Perioden) {H})", cubes, "native").first()
    assert (best["label"], best["Value"]) == ("2022JJ00", 35933)
    worst = compile(f"(MIN (Perioden) {H})", cubes, "native").first()
    assert (worst["label"], worst["Value"]) == ("2021JJ00", 31685)
    assert numbers(compile(f"(MAX (Perioden) {H})", cubes)) == [35933]
    assert compile(f"(MAX (Perioden) {H})", cubes, "simplified").first()["MAX[Perioden]"] == "2022JJ00"
    over = "(MAX () (VALUE 85302NED (MSR (M001339 M001860)) (DIM Seizoen (T001047)) (DIM Perioden (2021JJ00 2022JJ00))))"
    assert numbers(compile(over, cubes)) == [973, 1401]
    assert numbers(compile(over, cubes, "simplified")) == [1401]


def test_scaled_extremes(cubes):
    text = "({} () (VALUE 85302NED (MSR (D004645 D006211_2)) (DIM Seizoen (T001047)) (DIM Perioden (2021JJ00 2022JJ00))))"
    assert [round(x) for x in numbers(compile(text.format("MAX"), cubes, "native"))] == [205200000, 265400000]
    assert numbers(compile(text.format("MIN"), cubes, "native")) == [31685000, 35933000]


def test_proportion(cubes):
    text = f"(PROP (DIM Perioden (2021JJ00)) {H})"
    row = compile(text, cubes).first()
    assert (row["SUM[Perioden]"], row["2021JJ00"], row["%"]) == (67618, 31685, 46.86)
    native = compile(text, cubes, "native").first()
    assert native["%"] == pytest.approx(100 * native["2021JJ00"] / native["SUM[Perioden]"])


def test_joins(cubes):
    right = "(VALUE 85302NED (MSR (D006211_2)) (DIM Seizoen (T001047)) (DIM Perioden (2021JJ00 2022JJ00)))"
    rows = compile(f"(JOIN (Perioden) {F1.format('2021JJ00 2022JJ00')} {right})", cubes).collect()
    assert {r["Measure"]: (r["A045747"], r["T001047"]) for r in rows} == {"2021JJ00": (11003, 205.2), "2022JJ00": (9659, 265.4)}
    own = f"(JOIN (M004367) {F1.format('2021JJ00 2022JJ00')} {F1.format('2016JJ00 2017JJ00')})"
    assert numbers(compile(own, cubes)) == [9659, 11003, 17946, 19379]
    assert numbers(compile(f"(SUM () {own})", cubes)) == [57987]


def test_units_must_agree(cubes):
    wrong = "(SUM () (VALUE 84957NED (MSR (M004367 M004369)) (DIM Perioden (2021JJ00))))"
    with pytest.raises(UnitCompatibilityError, match="different unit"):
        compile(wrong, cubes)
    with pytest.raises(UnitCompatibilityError, match="dimensionless"):
        compile(wrong.replace("M004367 M004369", "D004645 M005005_2"), cubes)
    with pytest.raises(UnitCompatibilityError, match="different conversion multipliers"):
        compile("(SUM () (VALUE 85302NED (MSR (D004645 D006211_2)) (DIM Perioden (2021JJ00))))", cubes)


def test_parser_errors():
    assert parse("(A (B c))") == [["A", ["B", "c"]]]
    for text in ("(A (B c)", "(A))"):
        with pytest.raises(BracketError):
            parse(text)
    for text in ("(SUM () 3)", "(VALUE t (MSR ()))", "()", "(VALUE t (MSR (a b > 3)))x", ""):
        with pytest.raises((ExpressionError, AssertionError)):
            read(text)
    with pytest.raises(NotImplementedError):
        read(f"(SUM (g) (JOIN (g) {H} {H}))")


name = st.text("abcXYZ019_ #é", min_size=1, max_size=8)
code = st.text("abcXYZ019_ #é()<", min_size=1, max_size=8)
value = st.builds(lambda t, m, d: Value(t, tuple(m), tuple((g, tuple(c)) for g, c in d.items())), name, st.lists(name, min_size=1, max_size=2), st.dictionaries(name, st.lists(code, max_size=3), max_size=3))
compared = st.builds(lambda t, m, op, x: Value(t, (m,), (), (op, x)), name, name, st.sampled_from(["<", ">=", "!="]), st.floats(-1e6, 1e6))
node = st.one_of(value, compared, st.builds(lambda f, v: Aggregate(f, None, v), st.sampled_from(["SUM", "MAX"]), value), st.builds(lambda s, a, b: Join((s,), (a, b)), name, value, value), st.builds(lambda g, v: Proportion(g, ("x",), v), name, value))


@settings(max_examples=200, deadline=None)
@given(node)
def test_text_round_trip(n):
    assert read(write(n)) == n
