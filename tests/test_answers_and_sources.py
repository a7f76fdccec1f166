"""Stemming, the HTTP service against a local server, selections and the answering loop."""

import json
import threading
from difflib import SequenceMatcher
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pytest

from quadrille import queries
from quadrille.functions import stemming
from quadrille.metrics import selection
from quadrille.plans import answering
from quadrille.sources import service

ENGLISH = """consign consign|consignment consign|consistency consist|consolingly consol|conspiracy conspiraci|knightly knight|generously generous|national nation
relational relat|hopping hop|hoping hope|happy happi|cries cri|ties tie|dying die|running run|proceed proceed|sky sky|agreed agre|vietnamization vietnam|digitizer digit
caresses caress|gas gas|kiwis kiwi|falling fall|by by|say say|cry cri|rate rate|controlling control|electricity electr|adjustable adjust|decision decis|hopefulness hope"""
DUTCH = """lichaam licham|lichamelijk licham|lichamelijkheden licham|lichten licht|lichtere lichter|opglimpende opglimp|opglimping opglimp|opgroeien opgroei
opgroeiende opgroei|maan man|brood brod|provincies provincies|inwoners inwoner|boeken boek|bomen bom|eieren eier|veiligheid veilig"""


@pytest.mark.parametrize(("stem", "pairs"), [(stemming.english_stem, ENGLISH), (stemming.dutch_stem, DUTCH)])
def test_stems(stem, pairs):
    for pair in pairs.replace("\n", "|").split("|"):
        word, want = pair.split()
        assert stem(word) == want, word


def test_stemmed_keeps_nulls(spark):
    df = spark.createDataFrame([(["running", None],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(stemming.stemmed(df["w"])).collect()] == [["run", None], None, []]


def test_close_match(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    got = {r.p_partkey: r.close for r in queries.QUERIES["close_match"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: SequenceMatcher(None, n, names[k + 1]).ratio() >= 0.95 for k, n in names.items() if k + 1 in names}


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(unquote(self.path))
            q = parse_qs(urlsplit(self.path).query)
            if "busy" in self.path and len(asked) == 1:
                self.send_response(429)
                self.end_headers()
                return
            if "none" in self.path:
                self.send_response(404)
                self.end_headers()
                return
            if "TypedDataSet" in self.path:
                body = {"value": [{"ID": 1, "g": "a ", "m_1": 2, "m_2": None}]}
            elif "page" in q:
                body = {"value": [{"g": "b", "Measure": "m_1", "Value": 3.5}]}
            else:
                body = {"value": [{"g": "a", "Measure": "m_1", "Value": 1}], "@odata.nextLink": f"{urlsplit(self.path).path}?page=2"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_service(spark, server):
    base, asked = server
    rows = service.service(spark, base, "T", ["m_1"], {"g": ["a", "it's"]}).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "m_1", 1.0), ("b", "m_1", 3.5)]
    assert asked[0].endswith("/T/Observations?$filter=Measure in ('m_1') and g in ('a', 'it''s')")
    rows = service.service(spark, base, "T", ["m_1", "m_2"], {"g": ["a"], "h": []}, version=3).collect()
    assert [tuple(r) for r in rows] == [("a ", None, 2.0, None)]
    assert asked[-1].endswith("/T/TypedDataSet?$filter=(substringof('a',g))&$select=ID,g,h,m_1,m_2")


def test_fetch(server):
    base, asked = server
    assert service.fetch(f"{base}/busy", ["127.0.0.1"], wait=0.01)["value"] and len(asked) == 2
    assert service.fetch(f"{base}/none", ["127.0.0.1"]) is None
    with pytest.raises(PermissionError):
        service.fetch(f"{base}/x", ["7.0.0.1", "example.org"])


def test_referenced():
    assert selection.referenced("(SUM () (VALUE T (MSR (m_1)) (DIM g (a b))))") == ({"T"}, {"m_1", "a", "b"})
    tables, names = selection.referenced("""SELECT "m_1" FROM 'x/T.parquet' WHERE g IN ('a', 'b')""")
    assert tables == {"T"} and {"m_1", "g", "a", "b"} <= names
    assert selection.referenced("(SUM (") == (set(), set())


def test_selection_scores(spark):
    nodes = spark.createDataFrame([("T", "m", "measure"), ("T", "n", "measure"), *(("T", c, "code") for c in "abxy")], "table_id string, node_id string, kind string")
    tree = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "x"), ("h", "y")], "parent string, child string")
    names = spark.createDataFrame([(q, s, "T", n) for q, s, ns in [(1, "predicted", "ma"), (1, "truth", "mab"), (2, "predicted", "n"), (2, "truth", "m")] for n in ns], "question long, side string, table_id string, name string")
    rows = {r.question: r for r in selection.selection_scores(selection.selections(names, nodes, tree)).collect()}
    assert rows[1].measure_f1 == 1 and rows[1].dimension_f1 == pytest.approx(6 / 7) and rows[1].observation_f1 == pytest.approx(8 / 9) and rows[1].missing_dimensions == 1
    assert (rows[2].measure_f1, rows[2].dimension_f1, rows[2].observation_f1, rows[2].extra_measures) == (0, 1, 0, 1)


def test_pruned_text():
    sql = "SELECT * FROM t WHERE g IN ('a', 'zz') AND h IN ('q') AND p IN ('2020JJ00', '1900JJ00') -- g IN ('zz')"
    assert answering.pruned_text(sql, {"g": ["a"], "h": ["r"], "p": ["2020JJ00"]}) == sql.replace("('a', 'zz')", "('a')")
    assert answering.pruned_text(sql, {}) == sql


def test_answer():
    seen = []

    def writer(answers):
        answers = iter(answers)

        def write(text, remarks, heat):
            seen.append((text, remarks, heat))
            return next(answers)

        return write

    execute = lambda sql: None if "good" in sql else "no results"
    best = answering.answer("q", writer(["bad", "good 1", "good long"]), execute, candidates=3)
    assert (best.query, best.error, best.calls) == ("good long", None, 3)
    fixed = answering.answer("q", writer(["bad", "bad", "good"]), execute, hints="+h", evidence=lambda s: "see", finish=str.upper)
    assert (fixed.query, fixed.error, fixed.remarks) == ("GOOD", None, [("bad", "no results\nsee")])
    assert [x[0] for x in seen[3:]] == ["q+h", "q", "q+h"]
    assert answering.answer("q", writer(["bad"] * 3), execute).error == "no results"
    assert answering.answer("q", writer([""]), execute).query == ""
    assert "'a' (A)" in answering.evidence_text("SELECT 1 FROM t WHERE g IN ('z')", lambda c: [("a", "A")])
    assert answering.hint_text({"g": [("a", "")]}, ["2020JJ00"]).endswith("- g: 'a'\n- periods: 2020JJ00")
