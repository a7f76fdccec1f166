"""Fuzzy codes by shared grams against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import fuzzy
from quadrille.functions.text import best_window_ratio
from quadrille.operators import probing


def strings(rnd, n, letters="abcd é", most=14):
    made = ["".join(rnd.choices(letters, k=rnd.randint(0, most))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies, inside longer texts too
        x = list(rnd.choice(made))
        for _ in range(rnd.randint(0, 2)):
            if x:
                x[rnd.randrange(len(x))] = rnd.choice(["", "z", "ab"])
        made[i] = rnd.choice(["", "abc dd ", "zz"]) + "".join(x) + rnd.choice(["", " ba"])
    return made


@pytest.mark.parametrize(("seed", "threshold", "letters"), [(1, 80.0, "abcd é"), (2, 80.0, "abcdefghijklmnop"), (3, 60.0, "abcdefgh"), (4, 30.0, "abcdefghijklmnopqrstuvwxyz"), (5, 95.0, "ab"), (6, 100.0, "abc")])
def test_no_similar_pair_is_missing(spark, seed, threshold, letters):
    rnd = random.Random(seed)
    a, b = strings(rnd, 150, letters, 20), strings(rnd, 120, letters)
    frame = lambda x: spark.createDataFrame([(t,) for t in [*x, None, ""]], "text string")
    want = {(x, y) for x in {*a, ""} for y in {*b, ""} if best_window_ratio(x, y) >= threshold}
    got = [tuple(r) for r in probing.similar_texts(frame(a), frame(b), threshold).collect()]
    assert len(got) == len(set(got))
    assert want <= set(got)
    assert seed != 2 or len(got) < 0.5 * len(set(a)) * len(set(b))


@pytest.mark.parametrize("gate", [False, True])
def test_ranked_codes_are_those_of_all_pairs(spark, gate):
    rnd = random.Random(9)
    words = "north south houses detached barns total income people living of the".split()
    text = lambda n: " ".join(rnd.choices(words, k=n))
    q = spark.createDataFrame([(i, text(rnd.randint(3, 8)).title()) for i in range(40)] + [(99, None), (98, "")], "question_id long, q string")
    codes = spark.createDataFrame([(f"d{i % 3}", f"c{i}", text(rnd.randint(1, 3))) for i in range(80)] + [("d0", "n", None), ("d1", "e", "")], "dimension string, code string, l string")
    ranked = lambda low: sorted(map(tuple, probing.ranked_codes(q, codes, F.col("q"), F.col("l"), 4, low, gate).where("score >= 80").select("question_id", "dimension", "code", "score", "rank").collect()))
    assert ranked(80.0) == ranked(0.0)


def test_escapes_split_heavy_tokens(spark):
    """The same counts whether tokens are dealt to parts or not."""
    from quadrille.retrieval import ranking

    rnd = random.Random(4)
    index = spark.createDataFrame([(t, i) for i in range(300) for t in {"common", *rnd.sample("abcdefgh", 3)}], "token string, item long")
    asked = spark.createDataFrame([(k, " ".join(["common", *rnd.sample("abcdefgh", 2)])) for k in range(12)] + [(99, None)], "q long, t string")
    pool = spark.createDataFrame([(k, i) for k in range(12) for i in range(20)], "q long, item long")
    got = lambda heavy: sorted(map(tuple, ranking.escapes(index, asked, pool, "q", "item", F.split("t", " "), heavy=heavy).select("q", "item", "n").collect()))
    assert got(7) == got(100_000) and got(7)


def test_pairs_and_scores_are_those_of_all_pairs(spark, monkeypatch):
    """No pair below the threshold is left, texts beyond 64 characters too, and blocks meet as one would."""
    monkeypatch.setattr(probing, "TEXTS", 20)
    rnd = random.Random(7)
    a, b = (sorted({*strings(rnd, 60, "abcdefgh é", 16), *("".join(rnd.choices("ab", k=rnd.randint(60, 80))) for _ in range(4)), ""}) for _ in range(2))
    frame = lambda x: spark.createDataFrame([(t,) for t in [*x, None]], "text string")
    want = sorted((x, y, s) for x in a for y in b if (s := best_window_ratio(x, y)) >= 75)
    assert sorted(map(tuple, probing.similar_scores(frame(a), frame(b), 75.0).collect())) == want
    assert sorted(map(tuple, probing.similar_texts(frame(a), frame(b), 75.0).collect())) == [x[:2] for x in want]


def names(rnd, n):
    """Names of few syllables, which share most of their grams."""
    given, family = "an el jo lu ma to ri sa ke ne da ni".split(), "ez mah am gul kos on ham ren man vic ley tan loo ko ber or".split()
    return ["".join(rnd.choices(given, k=rnd.randint(2, 3))) + " " + "".join(rnd.choices(family, k=rnd.randint(2, 4))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_nearest_are_the_first_of_all_pairs(seed):
    rnd = random.Random(seed)
    letters, k, threshold = ["ab", "abcd é", "abcdefgh", "a\0b日本", "abcdefghijklmnop", "abc"][seed], [1, 2, 3, 5, 200, 3][seed], [75.0, 60.0, 80.0, 30.0, 80.0, 100.0][seed]
    long = lambda: ["".join(rnd.choices("ab", k=rnd.randint(60, 70))) for _ in range(4)]
    a, b = ([*dict.fromkeys([*strings(rnd, 80, letters, 20), *long(), ""])] for _ in range(2))
    rnd.shuffle(b)
    groups = np.array([rnd.randrange(3) for _ in b])
    ranked = [sorted((-s, j) for j, y in enumerate(b) if (s := best_window_ratio(y, x)) >= threshold) for x in a]
    got = lambda *of: sorted(zip(*(x.tolist() for x in fuzzy.nearest(a, b, k, threshold, *of)), strict=True))
    assert got() == sorted((i, j, -s) for i, row in enumerate(ranked) for s, j in row[:k])
    assert got(groups) == sorted((i, j, -s) for i, row in enumerate(ranked) for g in range(3) for s, j in [x for x in row if groups[x[1]] == g][:k])


def test_the_more_labels_the_fewer_of_them_are_compared(monkeypatch):
    """The threshold rises to the k-th best ratio found, so the work doesn't grow with the product of the two sides."""
    rnd, compared = random.Random(3), []
    asked, labels = [*dict.fromkeys(names(rnd, 600))], [*dict.fromkeys(names(rnd, 20_000))]
    monkeypatch.setattr(fuzzy._Tables, "ratios", lambda self, i, j, least, was=fuzzy._Tables.ratios: compared.append(len(i)) or was(self, i, j, least))
    i, j, score = fuzzy.nearest(asked, labels, 3, 80.0)
    few = np.flatnonzero(i < 20)
    left, right, all_of = fuzzy.similar(labels, asked[:20], 80.0)
    assert sorted(zip(i[few].tolist(), j[few].tolist(), score[few].tolist(), strict=True)) == sorted(x for n in range(20) for x in sorted(zip(right[right == n].tolist(), left[right == n].tolist(), all_of[right == n].tolist(), strict=True), key=lambda x: (-x[2], x[1]))[:3])
    assert sum(compared) < 0.06 * len(asked) * len(labels)


def test_copies_dont_meet_copies(spark):
    """Codes and questions of one text: a question gets the lowest codes without the pairs of all with all."""
    q = spark.range(400).select(F.col("id").alias("question_id"), F.when(F.col("id") < 390, "Anjo Kosham").otherwise("Lito Ezmah").alias("q"))
    codes = spark.range(600).select(F.lit("d").alias("dimension"), F.format_string("c%03d", F.col("id")).alias("code"), F.when(F.col("id") < 590, "anjo kosham").otherwise("anjo kosam").alias("l"))
    ranked = probing.ranked_codes(q, codes, F.col("q"), F.col("l"), 2)
    assert sorted(map(tuple, ranked.select("question_id", "code", "score", "rank").collect())) == [(i, f"c00{n}", 100.0, n + 1) for i in range(390) for n in range(2)]

    def made(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return made(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return made(plan.plan())
        below = [made(plan.children().apply(n)) for n in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
        return max([own, *below])

    ranked._jdf.collectToPython()
    assert made(ranked._jdf.queryExecution().executedPlan()) <= 800


def test_nearest_labels_by_blocks_and_dimensions(spark, monkeypatch):
    rnd = random.Random(5)
    q = spark.createDataFrame([(i, x) for i, x in enumerate([*strings(rnd, 60, "abcd", 14), None, "", ""])], "question_id long, q string")
    codes = spark.createDataFrame([(rnd.choice(["a", "b", None]), f"c{rnd.randrange(60)}", x) for x in [*strings(rnd, 90, "abcd", 14), None, "", ""]], "dimension string, code string, l string")
    ranked = lambda low: sorted(map(str, probing.ranked_codes(q, codes, F.col("q"), F.col("l"), 3, low).where("score >= 70").select("question_id", "dimension", "code", "score", "rank").collect()))
    want = ranked(0.0)
    assert ranked(70.0) == want
    for name, n in (("LABELS", 20), ("ASKED", 16), ("OWN", 4)):
        monkeypatch.setattr(probing, name, n)
    assert ranked(70.0) == want
