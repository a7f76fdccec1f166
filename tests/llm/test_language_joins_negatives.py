"""Operators 11 to 13 against brute force and held-out accuracy, with nulls, ties, repeats, empty tables and extra columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import hardnegatives, joinreplay, langid

SF = "/root/testdata/sf0.01"

# 11


def direct(network, window):
    """The network's log-probabilities of one window, filter by filter."""
    c = network.classes[np.frombuffer(window, np.uint8)]
    pooled = [max(sum(f[j][c[i + j]][k] for j in range(w)) for i in range(len(c) - w + 1)) for w, f in network.filters.items() for k in range(f.shape[2])]
    z = np.maximum(np.array(pooled) + network.bias, 0) @ network.weights + network.offset
    return z - z.max() - np.log(np.exp(z - z.max()).sum())


def test_windows_hold_every_run_of_bytes():
    for n in (0, 1, 63, 64, 65, 124, 125, 126, 1000):
        text = bytes(random.Random(n).choices(range(97, 123), k=n))
        windows = [w.tobytes() for w in langid.windows_of(text)]
        assert {len(w) for w in windows} == {langid.LENGTH}
        for i in range(n - 3):
            assert any(text[i : i + 4] in w for w in windows)
        assert b"".join(windows[:1]).rstrip() == text[:64].rstrip()
    assert langid.windows_of(None).tobytes() == b" " * 64


def test_network_tables_give_what_its_filters_give():
    rnd = np.random.default_rng(1)
    windows = np.concatenate([rnd.integers(97, 105, (40, langid.LENGTH)), rnd.integers(103, 115, (40, langid.LENGTH))]).astype(np.uint8)
    network = langid.fit(windows, np.repeat([0, 1], 40), ["a", "b"], epochs=60)
    got = network.log_probabilities(windows, network.tables())
    assert np.allclose(got, [direct(network, w.tobytes()) for w in windows], atol=1e-4)
    assert (got.argmax(axis=1) == np.repeat([0, 1], 40)).mean() > 0.95


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op11_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    en, de = "the house and the garden of the king ", "der hund und die katze über dem haus "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "x") for i in range(80)]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12 34!", "en", "x"), (None, en, "fr", "x"), (103, en, None, "x"), (103, en, None, "x"), (104, de * 3000, None, "x"), (105, "é", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    network = langid.learn(docs)
    assert network.names == ["de", "en"]
    got = {(r.doc_id, r.lang_pred, r.lang) for r in langid.identified(docs, network).collect()}
    assert {(100, "und", "en"), (101, "und", "de"), (102, "und", "en"), (None, "en", "fr"), (103, "en", None), (104, "de", None)} <= got
    assert langid.identified(docs, network).count() == len(rows)
    for few in (docs.where("false"), docs.where("lang IS NULL"), docs.where("doc_id IS NULL")):
        assert {r.lang_pred for r in langid.identified(docs, langid.learn(few)).collect()} == {"und"}
    assert langid.identified(docs.where("false"), network).collect() == []
    one = langid.identified(docs, langid.learn(docs.where("lang = 'en'"))).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


# 12


def joined(left, right):
    """Copies of the right outer join of (key, part) rows."""
    of = defaultdict(list)
    for key, part in left:
        of[key].append(part)
    out = Counter()
    for key, part in right:
        for other in (of.get(key) if key is not None else None) or ["-"]:
            out[key, other, part] += 1
    return out


def as_rows(states):
    """(batch, key, part, n) of the multisets of rows after each batch, as single rows."""
    before, out = Counter(), []
    for batch, state in enumerate(states):
        now = Counter(state)
        for row in set(now) | set(before):
            out += [(batch, *row, 1 if now[row] > before[row] else -1)] * abs(now[row] - before[row])
        before = now
    return out


def differences(lefts, rights):
    before, out = joined(lefts[0], rights[0]), set()
    for t in range(1, len(lefts)):
        now = joined(lefts[t], rights[t])
        out |= {(t, *row, now[row] - before[row], now[row]) for row in set(now) | set(before) if now[row] != before[row]}
        before = now
    return out


@pytest.mark.parametrize(("seed", "keys", "parts", "cell"), [(1, 30, 4, 500), (2, 2, 40, 7), (3, 1, 25, 3), (4, 200, 3, 2)])
def test_join_changes(spark, seed, keys, parts, cell):
    """Keys of a few parts and keys that are cut into grids of cells; parts that look like padding, null keys, copies."""
    rnd = random.Random(seed)
    names = ["-", *map(str, range(parts))]
    some = lambda most: [(rnd.choice([None, *map(str, range(keys))]), rnd.choice(names)) for _ in range(rnd.randint(0, most))]
    lefts, rights = [[some(150)] for _ in range(2)]
    for _ in range(4):
        for side in (lefts, rights):
            rest = [r for r in side[-1] if rnd.random() < 0.6] if rnd.random() < 0.8 else []
            side.append(rest + some(40))
    schema = "batch int, key string, part string, n long"
    tables = [spark.createDataFrame(as_rows(side), schema) for side in (lefts, rights)]
    got = joinreplay.right_outer_changes(*tables, cell_entries=cell, group_entries=20).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == differences(lefts, rights)


def test_join_changes_of_nothing(spark):
    schema = "batch int, key string, part string, n long"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(0, "k", "a", 2), (1, "k", "a", -1), (2, "k", "a", -1), (3, None, "a", 1)], schema)
    assert joinreplay.right_outer_changes(none, none).collect() == []
    assert joinreplay.right_outer_changes(one, none).collect() == []
    assert {tuple(r) for r in joinreplay.right_outer_changes(none, one).collect()} == {(1, "k", "-", "a", -1, 1), (2, "k", "-", "a", -1, 0), (3, None, "-", "a", 1, 1)}


def test_join_of_documents_and_labels(spark, tmp_path):
    """The contract's rule, row by row, with null ids and values, repeated ids, negative ids and a further column."""
    rnd = random.Random(5)
    docs = [(rnd.choice([None, *range(-20, 300)]), rnd.choice([None, "en", "de", "-", "null"]), 1) for _ in range(500)]
    labels = [(rnd.choice([None, *range(-20, 300)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(400)]
    spark.createDataFrame(docs, "doc_id long, lang string, batch int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = lambda p, i, t: zlib.crc32(f"{p}:{'null' if i is None else i}:{t}".encode())
    text = lambda x: "null" if x is None else str(x)
    lefts, rights = [[[] for _ in range(3)] for _ in range(2)]
    for side, prefix, rows in ((lefts, "d", docs), (rights, "l", labels)):
        for i, a, b in rows:
            there, updates = c(prefix, i, 0) % 3 != 0, 0
            for t in range(3):
                if t:
                    rest = c(prefix, i, t) % 19
                    updates += rest == 1 and there
                    there = not there if rest == 0 else there
                if there:
                    key = None if i is None else i // 3
                    if prefix == "d":
                        side[t].append((None if key is None else key + updates, text(a)))
                    else:
                        side[t].append((key, text(1 - a if a is not None and updates % 2 else a) + "," + text(b)))
    got = joinreplay.op12_join(spark, str(tmp_path))
    assert dict(got.dtypes) == {"batch": "int", "join_key": "bigint", "doc_part": "string", "label_part": "string", "weight": "bigint", "total": "bigint"}
    assert {tuple(r) for r in got.collect()} == differences(lefts, rights)


# 13


def mined(rows, positives=5, negatives=3):
    """Rows are (id, vector, label)."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, y in good:
        if i % 50:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i and len(w) == len(v)))
        for s, j, _ in [x for x in scores if x[2] == y][:positives]:
            fit = [(t, k) for t, k, z in scores if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "dim", "scale", "integers"), [(1, 8, 1.0, False), (2, 3, 0.05, False), (3, 64, 0.3, False), (4, 5, 1e6, False), (5, 4, 2e6, False), (6, 2, 4.0, True), (7, 1, 1.0, True)])
def test_hard_negatives(spark, monkeypatch, seed, dim, scale, integers):
    """Small and very large components, ties, repeats, odd rows and lengths; blocks and tiles of a few rows."""
    monkeypatch.setattr(hardnegatives, "SPREAD_ROWS", 40)
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (6, dim))
    made = [(centres[rnd.integers(6)] + rnd.normal(0, 0.4, dim)) * scale for _ in range(300)]
    made = [np.round(v) if integers else v for v in made]
    rows = [(int(i), [float(x) for x in v], int(rnd.integers(3))) for i, v in enumerate(made)]
    rows += [(350, None, 1), (400, [None] * dim, 1), (450, [float("nan")] * dim, 1), (500, [float("inf")] * dim, 1), (550, rows[0][1], None), (None, rows[0][1], 1), (600, rows[0][1] + [1.0], 1), (601, rows[0][1] + [1.0], 1), (650, [], 0), (651, [], 0), (652, [], 1), (700, [0.0] * dim, 1)]
    rows += [rows[7], rows[50], *((1000 + i, rows[1][1], i % 2) for i in range(30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x")).repartition(3)
    got = hardnegatives.mined(df, F.col("vec_id") % 50 == 0)
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_hard_negatives_drop_rows_before_their_last_planes(spark):
    """Less work than all pairs through all planes, on clusters."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 1, (20, 64))
    made = np.floor(256 * np.array([(v := centres[i % 20] + rnd.normal(0, 0.3, 64)) / np.linalg.norm(v) for i in range(2000)]))
    planes = hardnegatives.Planes(made[100:])
    a, r, s, work = hardnegatives.best_of(made[:100], np.arange(100), planes, np.arange(100, 2000), 5)
    assert np.array_equal(s, (made[a] * made[100:][r]).sum(axis=1).astype(np.int64))
    assert work < 0.75 * 100 * 1900 * (planes.bits + 1)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.mined(none, F.col("vec_id") % 50 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.mined(alone, F.col("vec_id") % 50 == 0).collect() == []
