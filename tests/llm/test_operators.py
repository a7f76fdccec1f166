"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, htmltext, nearcopies, packing, pii, secrets, sharding, shingles, simhash, tokenfiles, toxicity, vecdedup
from quadrille.llm.common import components, materialise, numbered

WORDS = "alpha beta gamma delta épsilon zeta eta theta".split()


def texts(n=60, seed=1):
    rnd = random.Random(seed)
    made = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 30))) for _ in range(n)]
    return [*made, None, "", "   ", made[0], made[0], made[1] + "!", "x " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that operators use themselves."""
    rows = [(i, t, i, "s", float(i)) for i, t in enumerate(texts())] + [(None, "null id", 1, "s", 0.0), (0, texts()[0], 0, "again", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long, spans string, score double").repartition(4)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# 1


def brute_overlaps(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        iw = words(text)
        size = min(13, len(iw))
        for win in {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == win:
                    hit |= set(range(i, i + size))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(5)
    line = lambda k: " ".join(rnd.choices(WORDS[:5], k=k))
    items = [(1, line(20)), (2, line(13)), (3, "Delta, ÉPSILON"), (4, ""), (5, None), (6, "unseen"), (10, line(14)), (2, "alpha alpha alpha"), (None, "beta beta beta"), (None, "zeta unseen")]
    made = [line(40) for _ in range(40)] + [f"x {items[0][1]} y", items[1][1].upper(), None, "", f"{items[0][1]} {items[0][1]}", "alpha " * 5000]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_verdict(decontaminate.overlaps(docs, bench, shard_words=100, block_bytes=block_bytes)).collect()
    assert len(found) == len(made)
    for r in found:
        n, hit, ids = brute_overlaps(made[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, ids)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(s.end - s.start for s in r.spans) == hit


def test_decontamination_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma", 1, "x"), (1, "alpha beta gamma", 2, "y"), (1, "alpha beta gamma", 2, "y"), (2, None, None, None)], "doc_id long, text string, n_hit int, Spans string")
    bench = spark.createDataFrame([(7, "beta gamma")], "item_id long, text string")
    for block_bytes in (1 << 20, 4):
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.overlaps(docs, bench, block_bytes=block_bytes).collect())
        assert got == [(0, 3, 2), (1, 3, 2), (1, 3, 2), (2, 0, 0)]


def test_decontamination_without_rows(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(none, bench).count() == 0
    assert decontaminate.overlaps(docs, bench).where("n_hit > 0").count() == 0


def test_suffix_order_and_fm_index():
    rnd = np.random.default_rng(2)
    s = np.append(rnd.integers(0, 4, 400), 0)
    s[100:150] = s[200:250] = 1
    index = decontaminate.FMIndex(s, 3, sample=8)
    for _ in range(300):
        p = rnd.integers(1, 4, rnd.integers(1, 9))
        low, high = index.search(np.array([p]), np.array([len(p)]))
        want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


# 2


def test_secrets(spark, docs, none):
    key, forge = "AKIA" + "Q7" * 8, "ghp_" + "aB3dE6gH9jK2mN5pQ8rS1tU4vW7xY0zA3bC6"
    made = [f"é😀 password: hunter2hunter2 and {key}!", f'API_KEY="{"ab12" * 9}"', "token=short", f"see {forge} here", "wholly clean prose about antidisestablishmentarianism", None, "", "f" * 31, "0" * 32 + "AKIA"]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    grammar = secrets.learn(secrets.labelled_credentials())
    got = {r.doc_id: r for r in secrets.scan(rows, grammar).collect()}
    spans = lambda i, c="spans": [(s.kind, made[i][s.start : s.end]) for s in got[i][c]]
    assert spans(0, "base") == [("assign", "password: hunter2hunter2"), ("access", key)]
    assert {k for k, _ in spans(1, "base")} == {"assign", "hex"}
    assert spans(2, "base") == [] and spans(7, "base") == []
    assert spans(3) == [("format", forge)]
    assert all(got[i].spans == [] for i in (4, 5, 6))
    assert spans(8, "base") == [("hex", "0" * 32)]
    masked = {r.doc_id: r.text for r in secrets.scan(rows, grammar, mask="[X]").collect()}
    assert masked[3] == "see [X] here" and masked[5] is None and masked[4] == made[4]
    assert secrets.scan(none.select("doc_id", "text"), grammar).count() == 0
    assert secrets.scan(docs.drop("spans"), grammar).count() == docs.count()


def test_base_secrets_equal_plain_patterns(spark):
    rnd = random.Random(15)
    parts = ["password", "Secret", "api_key", "apikey", "token", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "Q7Z2" * 3, "deadbeef" * 3, "0f" * 9, "abc", "x", "é", "😀", "-", ".", "\n", "9"]
    made = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    patterns = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)]
    found = secrets.scan(rows, secrets.learn(secrets.labelled_credentials())).collect()
    assert len(found) == len(made)
    for r in found:
        want = [(m.start(), k, m.end()) for k, (_, p, least, group) in enumerate(patterns) for m in re.finditer(p, made[r.doc_id]) if len(m[group]) >= least]
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.base] == sorted(want)
        assert {(s.start, s.end, s.kind) for s in r.base} <= {(s.start, s.end, s.kind) for s in r.spans}
        assert not any(s.kind == "format" and any(b.start < s.end and s.start < b.end for b in r.base) for s in r.spans)


def test_secrets_in_a_text_with_many(spark):
    text = " ".join(f"token = {'ab12Cd' * 4}{i} and ghp_{'aB3dE6gH9j' * 3}{i:06d}" for i in range(20_000))
    began = time.monotonic()
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), secrets.learn(secrets.labelled_credentials())).first()
    assert len(r.base) == 20_000 and len(r.spans) > 39_000 and time.monotonic() - began < 60


def test_grammar_inference():
    a = secrets.infer(["ab" * n for n in range(1, 9)] * 20)
    assert a.log2_likelihood("abababababab", 3) > a.log2_likelihood("aabbaabbaabb", 3) + 20
    held = secrets.labelled_credentials(seed=77)
    grammar = secrets.learn(secrets.labelled_credentials())
    caught = [bool(grammar.best(v)) for k, v in held if not k.startswith("plain")]
    wrong = [bool(grammar.best(v)) for k, v in held if k.startswith("plain")]
    assert np.mean(caught) > 0.98 and np.mean(wrong) < 0.01
    assert secrets.learn([]).best("x" * 20) is None


# 3


def test_sharding(spark, docs, none):
    rows = [(i, f"text {i}") for i in range(600)] + [(1000 + i, f"group {i % 40}") for i in range(200)] + [(3000 + i, "hot") for i in range(400)] + [(None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.balanced_shards(df).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len((t or "").encode()) + 8) for d, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in by.values()]
    assert len(by) == 24 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r.law == "rows" and r.grown_shard is None and r.text_crc32 >= 0 for r in got)
    where = {}
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 1200:
            where.setdefault((r.doc_id - 1000) % 40, set()).add(r.shard)
    assert sum(len(s) == 1 for s in where.values()) >= 36
    hot = {r.shard for r in got if r.doc_id is not None and r.doc_id >= 3000}
    assert len(hot) <= 16  # 400 rows need eight of the shards of 50; at most twice as many
    assert sharding.balanced_shards(none).count() == 0
    assert sharding.balanced_shards(docs).count() == docs.count()


def test_few_links_are_cut(spark):
    """Groups that fit shards exactly, and one that fills eight of them; all rows are linked, so nothing makes room but what
    moves. The best assignment cuts no link of the small groups; a hash keeps one in 24."""
    rnd = random.Random(25)
    rows = [(g * 100 + i, f"group {g}") for g in range(160) for i in range(10)] + [(50_000 + i, "hot") for i in range(800)]
    rnd.shuffle(rows)
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {}
    for r in got:
        by.setdefault(dict(rows)[r.doc_id], []).append(r.shard)
    pairs = lambda k: k * (k - 1) // 2
    kept = sum(pairs(v.count(s)) for t, v in by.items() if t != "hot" for s in set(v))
    every = sum(pairs(len(v)) for t, v in by.items() if t != "hot")
    assert kept > 0.4 * every
    by_hash = sum(pairs(sum(1 for i in range(10) if hash((g, i)) % 24 == s)) for g in range(160) for s in range(24))
    assert kept > 5 * by_hash
    hot = by["hot"]  # 100 rows a shard: eight shards' worth keep 8 * 4950 of the pairs at best
    assert sum(pairs(hot.count(s)) for s in set(hot)) > 0.35 * 8 * pairs(100)


# 4


def test_vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 16))
    v = np.concatenate([base, base[:20] + rnd.normal(size=(20, 16)) * 0.1, np.repeat(base[:1], 300, axis=0) + rnd.normal(size=(300, 16)) * 0.15, np.repeat(base[1:2], 50, axis=0)])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 16)]
    got = {r.vec_id: r for r in vecdedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.array([label[x].min() for x in s])
        if (new == label).all():
            break
        label = new
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (s[i].sum() - 1, label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (900, 901, 902, 903, 904, 907))
    assert got[906].component_id == 905 and got[905].n_links == 1
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vecdedup.near_vectors(empty).count() == 0


@pytest.mark.parametrize("tight", [True, False])
def test_provably_distant_intervals_are_skipped(tight, monkeypatch):
    """Clusters at right angles: few but vectors of one cluster are compared. Without clusters nothing is lost either."""
    monkeypatch.setattr(vecdedup, "LEAF", 32)
    rnd = np.random.default_rng(23)
    centres = np.linalg.qr(rnd.normal(size=(32, 32)))[0][:8] if tight else rnd.normal(size=(4000, 32))
    v = vecdedup.unit(np.repeat(centres, 4000 // len(centres), axis=0) + rnd.normal(size=(4000, 32)) * 0.02)
    grid = vecdedup.Grid(v[::4], 0.9, 4)
    v = v[grid.order(grid.project(v))]
    links, root, compared = vecdedup.join(v, np.ones(len(v), np.int64), len(v), grid, 0.9)
    near = v @ v.T >= 0.9
    assert (links == near.sum(axis=1) - 1).all() and (root[np.nonzero(near)[0]] == root[np.nonzero(near)[1]]).all()
    every = len(v) * (len(v) - 1) / 2
    assert compared < 0.35 * every if tight else compared <= 1.2 * every


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(vecdedup, "LEAF", 16)
    rnd = np.random.default_rng(24)
    v = vecdedup.unit(np.repeat(rnd.normal(size=(90, 12)), 8, axis=0) + rnd.normal(size=(720, 12)) * 0.12)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[3].tolist()), (5, v[9].tolist()), (5, None)]
    got = vecdedup.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, Kept string, n_links int").repartition(4)).collect()
    every = np.array([r[1] for r in rows[:-1]])
    near = every @ every.T >= 0.9
    assert sorted(r.n_links for r in got if not (r.vec_id == 5 and r.n_links == 0)) == sorted((near.sum(axis=1) - 1).tolist()) and len(got) == len(rows)


# 5


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, docs, none):
    rnd = random.Random(9)
    parts = ["a", "b.c", "@", "@x.y", "1", "22", " ", "-", ".", "+1", "(", "é", "😀", "4111 1111 1111 1111", "1.2.3.4", "%", "_", "\x01", "300.1.1.1", "+1 (724) 555-7058", "q@w.e_r@t.y", "\n"]
    made = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(1500)] + ["9" * 20_000, "a" * 20_000 + "@" + "b." * 3000 + "c", "1 " * 10_000]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string").repartition(8)
    got = {r.i: [(pii.KINDS[s.kind], s.start, s.end) for s in r.b] for r in df.select("i", pii.base_spans(F.col("t")).alias("b")).collect()}
    assert all(got[i] == brute_pii(t) for i, t in enumerate(made))
    assert pii.find(none).count() == 0
    assert pii.find(docs).count() == docs.count()


def test_disclosing_terms(spark):
    rows = [(i, f"common words here, contact Zebulon at zeb@mail.example.com please {i}") for i in range(5)]
    rows += [(100 + i, f"common words here, contact nobody please number{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.find(df)
    got = {r.doc_id: [(rows[r.doc_id][1][s.start : s.end]) for s in r.terms] for r in found.collect() if r.doc_id < 100}
    assert all(terms == ["Zebulon"] for terms in got.values())
    out = df.join(found, "doc_id").select("doc_id", pii.sanitised(F.col("text"), F.col("base"), F.col("terms")).alias("t"))
    shown = {r.doc_id: r.t for r in out.collect()}
    assert shown[3] == "common words here, contact [TERM] at [EMAIL] please 3" and shown[101] == rows[6][1]


def brute_disclosing(texts_):
    """{text: the terms that disclose one of its identifiers} by the definition, over distinct texts."""
    from math import log, log2

    texts_ = list(dict.fromkeys(texts_))
    terms = {t: {m[0].lower() for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]{4,}", t)} for t in texts_}
    value = lambda t, k, a, b: re.sub("[^0-9]", "", t[a:b]) if k == "card" else t[a:b].lower()
    held = {t: {value(t, *x) for x in brute_pii(t)} for t in texts_}
    n = len(texts_)
    has = lambda sets, x: {t for t in texts_ if x in sets[t]}
    out = {t: set() for t in texts_}
    for e in set().union(*held.values()):
        de = has(held, e)
        for w in set().union(*(terms[t] for t in de)):
            dw = has(terms, w)
            k, a, b = len(de & dw), len(dw), len(de)
            cells = [(k, a, b), (a - k, a, n - b), (b - k, n - a, b), (n - a - b + k, n - a, n - b)]
            g2 = 2 * sum(o * log(o * n / (x * y)) for o, x, y in cells if o)
            if n > b and log2(k * n / (a * b)) >= 0.9 * log2(n / b) and g2 >= 10.83:
                for t in de & dw:
                    out[t].add(w)
    return out


def test_disclosing_terms_equal_brute_force(spark):
    rnd = random.Random(17)
    names = ["zebulon", "marvolo", "quintus", "ottoline", "perpetua"]
    made = []
    for i in range(400):
        t = rnd.choices("common words here about rivers bridges towns market water stone".split(), k=12)
        if i % 5 == 0:
            k = rnd.randrange(len(names))
            t += [names[k].title(), f"{names[k]}@mail.example.com", *(["10.0.0.%d" % k] if rnd.random() < 0.5 else [])]
            if rnd.random() < 0.3:
                t += [names[(k + 1) % 5], f"x{i}unique", f"only{i}@a.example.org", "4111 1111 1111 1111"]
            rnd.shuffle(t)
        made.append(" ".join(t))
    made += made[:40]
    want = brute_disclosing(made)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(4)
    found = 0
    for r in pii.find(df).collect():
        t = made[r.doc_id]
        base = brute_pii(t)
        spans = [m.span() for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]{4,}", t) if m[0].lower() in want[t] and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert [(s.start, s.end) for s in r.terms] == spans
        found += len(spans)
    assert found > 50


def test_pii_of_a_text_with_very_many_identifiers(spark):
    long = " ".join(f"näme word{i} user{i}x@mail{i}.example.com Únique{'abcdefghij'[i % 10] * (4 + i // 10 % 40)}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), *((i, f"plain text of the town {i}") for i in range(2, 400))], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got[1].base) == 20_000 and [(s.start, s.end) for s in got[1].base] == [m.span() for m in re.finditer(r"user\S+com", long)]
    assert len(got[1].terms) >= 20_000 and not got[2].terms and time.monotonic() - began < 120


def test_rare_identifiers_disclose(spark):
    """An identifier in a single text is protected as any other; copies of a text are no evidence of their own."""
    rows = [(0, "common words here, ask Zebulon at zeb@mail.example.com please")]
    rows += [(i, "common words here, ask Marvolo at mar@mail.example.com please") for i in range(1, 9)]
    rows += [(100 + i, f"common words here, ask nobody please {i}") for i in range(200)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    texts_of = dict(rows)
    got = {r.doc_id: [texts_of[r.doc_id][s.start : s.end] for s in r.terms] for r in found.collect()}
    assert got[0] == ["Zebulon"] and all(got[i] == ["Marvolo"] for i in range(1, 9)) and not any(got[100 + i] for i in range(200))


def test_disclosing_terms_far_from_the_identifier(spark):
    far = "common words here " * 40
    rows = [(i, f"Zebulon {far} zeb@mail.example.com {far} Zebulon {i}") for i in range(5)]
    rows += [(100 + i, f"{far} {i}") for i in range(60)]
    got = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts_of = dict(rows)
    assert all(got[i] == [m.span() for m in re.finditer("Zebulon", texts_of[i])] for i in range(5)) and not any(got[100 + i] for i in range(60))


# 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<h1>A &amp; B</h1><p>one  two<p>three<br>four", "A & B\n\none two\n\nthree\nfour"),
        ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol><li>z</ul>", "- x\n- y\n  3. n\n  4. m\n- z"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name      | N\nlong name | 1\nb         | 22"),
        ("<div hidden>no</div><p style='color:red; display : none'>no<p>yes<!-- no --><script>if (a<b) no</script>", "yes"),
        ("<pre>a\n  b</pre>c<template>no</template>", "a\n  b\n\nc"),
        ("<b>a</b> <i>b</i><span>c</span>\n d", "a bc d"),
        ("1 < 2 &lt; &eacute;&#x41;&nosuch;", "1 < 2 < éA&nosuch;"),
        ("<td>loose</td></nothing><p></p>x</p>", "loose \n\nx"),
        ("", ""),
        ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        | b\n\nin | ner"),
        ("<a title=it's>hello</a> world, it's <b>fine</b>", "hello world, it's fine"),
        ('<p class=a">hello</p><p id="b">two</p>', "hello\n\ntwo"),
        ("<a href='x>y' b=c/d>t</a><a b = \"q'>\">u</a><a =x>v</a>", "tuv"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>B</b>c</div>d", "B\nd"),
        ("<ul><li style='visibility:hidden'>x<li>y</ul>", "- y"),
        ("<table><tr><td colspan=2>AB<td>C<tr><td>a<td>b<td>c</table>", "AB    | C\na | b | c"),
        ("<table><tr><td rowspan=2>tall<td>x<tr><td>y<tr><td>z<td>w</table>", "tall | x\n     | y\nz    | w"),
        ("<table><tr><td rowspan=0>r<td>x<td rowspan=2>s<tr><td>y<tr><td>z<td>t</table>", "r | x | s\n  | y |\n  | z | t"),
        ("<table><tr><td colspan=1000>wide cell here<td>e<tr><td>a</table>", "wide cell here | e\na"),
        ("<svg><title>no</title><text>label</text><desc>no</desc></svg> <math><mi>x</mi><annotation>no</annotation></math>", "label x"),
        ("<head><title>t</title>text here<p>x", "text here\n\nx"),
    ],
)
def test_html(html, text):
    got = htmltext.visible_text(html)
    assert [x.rstrip(" |") for x in got.splitlines()] == [x.rstrip(" |") for x in text.splitlines()]


class PlainRenderer(HTMLParser):
    """The visible words in order, by the standard library's tokeniser: for trees whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in htmltext.VOID:
            style = dict(attrs).get("style") or ""
            self.open.append((tag, tag in htmltext.HIDDEN or "hidden" in dict(attrs) or "none" in style))

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def test_html_words_equal_an_independent_renderer():
    rnd = random.Random(31)

    def tree(depth):
        out = []
        for _ in range(rnd.randint(1, 4)):
            tag = rnd.choice(["div", "span", "b", "section", "em", "blockquote", "template", "article", "h2", "ul", "table"])
            attrs = rnd.choice(["", " hidden", " style='display:none'", ' title="a > b"', " data-x=it's", " class=a b"])
            inner = f"w{rnd.randrange(1000)} &amp;{rnd.randrange(9)}" if depth > 4 or rnd.random() < 0.3 else tree(depth + 1)
            if tag == "h2":
                inner = f"head{rnd.randrange(100)}"
            if tag == "ul":
                inner = "".join(f"<li>{x}</li>" for x in (inner, "item"))
            if tag == "table":
                inner = f"<tr><td>{rnd.randrange(100)}</td><td>cell{rnd.randrange(100)}</td></tr>"
            out.append(f"<{tag}{attrs}>{inner}</{tag}><!-- {rnd.randrange(9)} > -->\n")
        return "".join(out)

    for _ in range(400):
        page = tree(0)
        plain = PlainRenderer()
        plain.feed(page)
        plain.close()
        assert [w for w in htmltext.visible_text(page).split() if w not in ("-", "|")] == plain.words


def test_html_takes_time_by_length_and_not_by_depth():
    began = time.monotonic()
    for page in ("<div>" * 200_000 + "x", "<p><object>" + "<div>" * 200_000 + "x", "<li><i>" * 30_000, "<td colspan=1000>x" * 3000, "<b>" * 50_000 + "</i>" * 50_000, "<a b='" * 100_000, "<a" + " =" * 200_000):
        htmltext.visible_text(page)
    assert time.monotonic() - began < 60


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "x"), (1, "<p>a</p>", "x"), (None, "<p>b", None)], "page_id long, html string, Text string")
    assert sorted((r.page_id or 0, r.text) for r in htmltext.extract(pages).collect()) == [(0, "b"), (1, "a"), (1, "a")]
    assert htmltext.extract(pages.where("false")).count() == 0


def test_html_survives_anything(spark):
    rnd = random.Random(4)
    parts = ["<p", ">", "</", "<!--", "-->", "<table>", "<td>", "<li>", "</ul>", "<ul>", "x", " ", '"', "&", "<script>", "</script>", "<br>", "\n", "<select><option>", "</table>", "<pre>", "<tr>"]
    for _ in range(3000):
        assert isinstance(htmltext.visible_text("".join(rnd.choices(parts, k=rnd.randint(0, 25)))), str)
    assert htmltext.visible_text("<div>" * 50_000 + "x") == "x"
    rows = spark.createDataFrame([(1, None, "old"), (2, "<p>a", "old"), (3, "", "old")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in htmltext.extract(rows).collect()} == {1: None, 2: "a", 3: ""}


# 7


def test_boundaries_are_optimal():
    from itertools import combinations

    rnd = random.Random(6)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 8)))
        steps = [(x, n := rnd.randint(1, 9), x * n) for x in lengths]
        for buckets in (1, 2, 3, 9):
            bounds = packing.best_boundaries(steps, buckets)
            pad = lambda bs: sum(n * (min(b for b in bs if b >= x) - x) for x, n, _ in steps)
            best = min(pad((*c, lengths[-1])) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
            assert len(bounds) <= buckets and pad(bounds) == best
    assert packing.best_boundaries([], 4) == []


def test_packing(spark, docs, none):
    got = packing.pack(docs, packing.byte_tokens(), budget=500).collect()
    assert len(got) == docs.count()
    batches = {}
    for r in got:
        assert r.n_tokens <= r.boundary
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0].boundary <= 500
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert packing.pack(none, packing.byte_tokens()).count() == 0


def test_boundaries_by_halving_equal_the_plain_programme():
    rnd = random.Random(16)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(1, 5000), rnd.randint(20, 150)))
        steps = [(x, n := rnd.choice((1, 1, 5, 300)), x * n) for x in lengths]
        best = {0: 0}
        for _ in range(6):  # the least padding of the steps before j in one bucket more
            best = {j: min(p + sum(n * (lengths[j - 1] - x) for x, n, _ in steps[i:j]) for i, p in best.items() if i < j or i == j == 0) if j else 0 for j in range(len(steps) + 1)} if len(best) == 1 else {j: min([best[j]] + [best[i] + sum(n * (lengths[j - 1] - x) for x, n, _ in steps[i:j]) for i in range(j)]) for j in best}
        bounds = packing.best_boundaries(steps, 6)
        assert len(bounds) <= 6 and sum(n * (min(b for b in bounds if b >= x) - x) for x, n, _ in steps) == best[len(steps)]


def test_no_boundary_exceeds_the_longest_row(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 5, 1500, 40_001, 40_003, 999_999])], "doc_id long, n long")
    got = packing.pack(df, F.col("n"), buckets=3).collect()
    assert max(r.boundary for r in got) == 999_999 and all(r.n_tokens <= r.boundary for r in got)


@pytest.mark.parametrize("n", [1, 1000, 1023, 1024, 1025, 5000, 122_698, 2**33 + 1])
def test_steps(spark, n):
    step = spark.range(1).select(F.expr(packing.step_of(f"{n}L"))).first()[0]
    assert n <= step <= n * (1 + 2 / 1024) and (n > 1024 or step == n)


# 8


def brute_print(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert all(prints[i] == brute_print(t) for i, t in rows.items())
    ids = sorted(i for i in prints if i is not None)
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            low[a] = min(low[b] for b in ids if (prints[a] ^ prints[b]).bit_count() <= 2)
    assert all(r.component_id == low[r.doc_id] for r in got if r.doc_id is not None)
    nameless = [r for r in got if r.doc_id is None]
    assert nameless and all(r.component_id == min((low[i] for i in ids if (prints[i] ^ r.fp & (2**64 - 1)).bit_count() <= 2), default=None) for r in nameless)
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies_are_those_of_brute_force(spark):
    """Edits that move a print by more than op8's 2 bits, at either side of 0.8."""
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(n)] for n in (30, 60, 100, 200, 400)]
    made = [None, "", "one two", "one two", "one  TWO"]
    for words_ in base:
        made.append(" ".join(words_))
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05):
            made.append(" ".join("changed" if rnd.random() < share else w for w in words_))
    made += [" ".join(["the line that all have in this table", *(f"v{rnd.randrange(5000)}" for _ in range(20))]) for _ in range(30)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in made]
    low = list(range(len(made)))
    for _ in made:
        low = [min(low[j] for j, y in enumerate(sets) if x == y or x & y and len(x & y) >= 0.8 * len(x | y)) for x in sets]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()}
    assert got == dict(enumerate(low))
    rows_ = nearcopies.near_copies(df.union(spark.createDataFrame([(None, made[5]), (2, made[8]), (2, made[2])], "doc_id long, text string"))).collect()
    firsts = [r for r in rows_ if r["first"]]
    assert {r.component_id for r in firsts} == set(low) - {5} and len(firsts) == len(set(low)) + 1  # (2, "one two") twice is one document
    assert not any(r["first"] for r in rows_ if r.doc_id is None)
    assert any(low[i] != i and (brute_print(made[i]) ^ brute_print(made[low[i]])).bit_count() > 2 for i in range(len(made)))
    assert nearcopies.near_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    """Every set shares shingles with every other; with small blocks the group is dealt in many."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rnd = random.Random(21)
    made = []
    for size, many in ((150, 160), (900, 40)):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for i in range(many):
            words_ = list(base)
            for _ in range(size // 50 if i % 3 else size // 150):
                words_[rnd.randrange(len(words_))] = f"c{rnd.randrange(10**6)}"
            made.append(" ".join(words_))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, made)]
    low = list(range(len(made)))
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    for _ in range(len(made)):
        new = [min(low[j] for j in js) for js in near]
        if new == low:
            break
        low = new
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()} == dict(enumerate(low))
    assert 2 < len(set(low)) < len(made) // 2


def test_shingles_of_batches():
    rnd = random.Random(22)
    made = ["".join(rnd.choices(["a", "B", "é", " ", "\t", "\n", "word", "\x1c", "\u2003", "x" * 30], k=rnd.randint(0, 60))).encode() for _ in range(300)]
    made += [None, b"", b" ", b"z" * 1_000_000, b"long words here " * 100_000]
    sets = shingles.shingle_sets(made, 5)
    names = {}
    for text, found in zip(made, sets, strict=True):
        w = (text or b"").lower().split()
        plain = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(plain) == len(found) and (found[1:] > found[:-1]).all()
        alone = {int(shingles.shingle_sets([b"\n".join(one) + b" "], 5)[0][0]) for one in plain}  # as a text of its own
        assert alone == set(found.tolist())
        for one, h in zip(sorted(plain), (int(shingles.shingle_sets([b" ".join(x)], 5)[0][0]) for x in sorted(plain)), strict=True):
            assert names.setdefault(h, one) == one
    for x in sets[:60]:
        for y in sets[:60]:
            size = min(len(shingles.sketch(x)), len(shingles.sketch(y)))
            bits = int(np.bitwise_count(shingles.folded(shingles.sketch(x), size) ^ shingles.folded(shingles.sketch(y), size)).sum())
            assert bits <= len(np.setxor1d(x, y))


@pytest.mark.parametrize(("shard_prints", "most"), [(256, 2048), (16, 64), (64, 8), (10_000, 4)])
def test_links_within_the_radius(spark, shard_prints, most):
    rnd = random.Random(8)
    values = [rnd.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for _ in range(8):
            x = v
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(5)
    found = {r.node: r.root for r in components(simhash.hamming_links(df, shard_prints=shard_prints, most=most)).collect()}
    groups = {v: v for v in values}

    def root(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                groups[root(a)] = root(b)
    same = lambda f: {frozenset(v for v in values if f(v) == k) for k in map(f, values)}
    assert same(root) == same(lambda v: found.get(signed(v), signed(v)))


def test_trees_follow_only_edges_within_the_radius():
    rnd = np.random.default_rng(14)
    values = rnd.integers(0, 1 << 63, 600, dtype=np.uint64)
    values = np.unique(np.concatenate([values, values ^ np.uint64(5), values ^ np.uint64(1 << 40), values ^ np.uint64(7)]))
    rnd.shuffle(values)
    tree = simhash.BKTree(values)
    for radius in (0, 1, 2, 3):
        tree.visited = 0
        a, b = tree.near(values, radius)
        want = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= radius)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(zip(*(x.tolist() for x in want), strict=True))
        assert len(values) < tree.visited < 0.1 * len(values) ** 2
    assert len(simhash.BKTree(values[:0]).near(values, 2)[0]) == 0


def test_most_prints_of_a_table_meet_others_in_a_tree(spark, monkeypatch):
    """On a real table the trees do the work: shards hold many prints."""
    prints = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).select("fp").distinct()
    rows = [(r.fp,) for r in prints.collect()]
    monkeypatch.setattr(simhash, "_tree_links", lambda radius: lambda batches: (b.select([0, 1]).rename_columns(["a", "b"]) for b in batches))
    dealt = simhash.hamming_links(spark.createDataFrame(rows, "fp long"))
    shards = dealt.groupBy("a", "b").count().collect()  # combo and key
    assert sum(r["count"] for r in shards) >= 3 * len(rows) and max(r["count"] for r in shards) > 100


# 9


def test_toxicity(spark):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(40)] + (["Idiot!", "scum"] if bad else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(None, None), (5000, ""), (5001, "x " * 20_000)]
    labels += [(None, 1), (0, None), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    assert got[None] == got[5000] and all(0 <= s <= 1 for s in got.values())
    assert len(model.features) < 2000
    assert toxicity.scored(docs.where("false"), model).count() == 0
    blank = toxicity.learn(docs, known.where("false"))
    assert len(blank.features) == 0


def test_ftrl_equals_a_scalar_version():
    rnd = random.Random(19)
    rows = [(" ".join(rnd.choices(WORDS, k=6) + (["bad"] if i % 3 == 0 else [])).encode(), int(i % 3 == 0)) for i in range(40)]
    alpha, beta, l2, epochs, seed = 1.0, 1.0, 0.5, 3, 7
    l1 = 0.02 * len(rows) ** 0.5
    hasher = toxicity.Hasher(12)
    z, n, bias, bias_n = {}, {}, np.log((sum(y for _, y in rows) + 0.5) / (sum(1 - y for _, y in rows) + 0.5)), 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, y = sorted(set(hasher(rows[k][0]).tolist())), rows[k][1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + bias_n**0.5)
    model = toxicity.fit(rows, l1=0.02, epochs=epochs, bits=12)
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-4) and model.bias == pytest.approx(bias)


def test_a_tuned_model_on_held_out_documents():
    import pandas as pd

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.dropna(subset=["doc_id", "toxic"]).groupby("doc_id").toxic.max().reset_index().merge(docs, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in known.doc_id])
    rows = [((t or "").encode(), int(y)) for t, y in zip(known.text, known.toxic, strict=True)]
    model = toxicity.tuned([r for r, h in zip(rows, held, strict=True) if not h])
    dense, hasher = model.dense(), toxicity.Hasher()
    got = [(toxicity.score(dense, model.bias, hasher(t)) >= 0.5, y) for (t, y), h in zip(rows, held, strict=True) if h]
    toxic = [p for p, y in got if y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(p for p, y in got if not y) <= 0.01 * (len(got) - len(toxic))
    assert len(model.features) < 1000


def test_tuned_without_evidence():
    nothing, clean, toxic = toxicity.tuned([]), toxicity.tuned([(b"fine", 0)] * 9), toxicity.tuned([(b"vile", 1)] * 9)
    assert nothing.bias == toxicity.UNKNOWN and clean.bias < 0 < toxic.bias and not len(nothing.features) + len(clean.features) + len(toxic.features)
    mixed = toxicity.tuned([(None, 0), (b"", 1), (b"", 0), *[(b"vile scum %d" % i, 1) for i in range(30)], *[(b"nice day %d" % i, 0) for i in range(30)]])
    dense, hasher = mixed.dense(), toxicity.Hasher()
    marked = lambda t: toxicity.score(dense, mixed.bias, hasher(t)) >= 0.5
    assert marked(b"vile scum") and not marked(b"nice day") and not marked(None) and not marked(b"unheard-of words")


def test_the_cut_with_the_largest_f1():
    z, y = np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 1, 0])
    f1, cut = toxicity._cut(z, y)
    assert (round(f1, 6), cut) == (round(6 / 7, 6), 0.5)


def test_repeated_ids_and_a_clashing_score(spark):
    docs = spark.createDataFrame([(1, "vile scum", 9.0), (1, "vile scum", 9.0), (1, "other", 9.0), (2, "nice", 9.0), (None, "x", 9.0)], "doc_id long, text string, score double")
    model = toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int"), rows_per_label=1)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)


# 10


def test_token_files(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(77, "one <|endoftext|> two"), (77, "one"), (78, "<|endoftext|>")], "doc_id long, text string"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = tokenfiles.read(tokenfiles.write(docs, str(tmp_path / "t"), path), str(tmp_path / "t")).orderBy("start").collect()
    at = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfiles.read(tokenfiles.write(none, str(tmp_path / "e"), path), str(tmp_path / "e")).count() == 0


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    rnd = random.Random(12)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "﻿", "a", "b'll", "'s", "12", "é", "中文", "...", "!", "<|endoftext|>", "\r\n", "²", "🙂", "\x00", "foo", "bar.", "x,\ny", "a_b"]
    for _ in range(5000):
        w = "".join(rnd.choices(parts, k=rnd.randint(0, 9)))
        assert t.encode(w, add_special_tokens=False).ids + [2] == np.frombuffer(e(w), "<u2").tolist(), repr(w)


# shared


def test_components(spark):
    rnd = random.Random(13)
    edges = [(rnd.randint(-50, 50), rnd.randint(-50, 50)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = materialise(spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("k")), "numbers")
    rows = numbered(df, ["k"], [F.col("id")], F.xxhash64("id"), 3000, "at", per_bucket=100).collect()
    for k, n in (("hot", 2500), ("cold", 500)):
        assert sorted(r["at"] for r in rows if r.k == k) == list(range(n))


def test_formats_are_told_from_what_is_only_random():
    """Credentials and background that weren't learned from: at least 95 of 100 of each kind are found, and UUIDs, encoded content,
    digests in capitals, names of built files and all other background are left alone."""
    import base64
    import uuid

    grammar = secrets.learn(secrets.labelled_credentials())
    found = lambda v: len(v) >= grammar.shortest and grammar.best(v) is not None
    by = {}
    for kind, value in secrets.labelled_credentials(200, seed=99):
        by.setdefault(kind, []).append(found(value))
    for kind, hits in by.items():
        assert sum(hits) <= 0.005 * len(hits) if kind.startswith("plain") else sum(hits) >= 0.95 * len(hits), kind
    rnd = random.Random(3)
    made = [str(uuid.UUID(int=rnd.getrandbits(128))) for _ in range(300)] + [base64.b64encode(rnd.randbytes(300)).decode() for _ in range(100)] + [hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(100)]
    assert not any(map(found, made))
