"""Operator 12: a right outer join kept up to date through batches of changes, by replaying each key's changes."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import discard, materialise

#: Distinct entries (part and batch) of one side of a key that meet in one cell; a key with more is cut into several.
CELL_ENTRIES = 500
#: Entries of a group, in which many small keys are replayed one after the other.
GROUP_ENTRIES = 1000
PAD = "-"
#: How a cell pads: by its own left entries, not at all, or by the key's left totals.
OWN, NEVER, TOTALS = 0, 1, 2


class State:
    """The multisets of one cell: copies by part, and the number of left rows of the key."""

    def __init__(self, mode: int) -> None:
        self.mode, self.left, self.right, self.n = mode, Counter(), Counter(), 0

    def advance(self, side: int, part: str | None, n: int) -> None:
        if side == 2:
            self.n += n
            return
        of = self.right if side else self.left
        of[part] += n
        if not of[part]:
            del of[part]
        if not side and self.mode == OWN:
            self.n += n

    def copies(self, left: str, right: str) -> int:
        found = self.left[left] * self.right[right]
        return found + self.right[right] if left == PAD and self.mode != NEVER and not self.n else found

    def step(self, changes: list[tuple[int, str | None, int]]) -> Iterator[tuple[str, str, int, int]]:
        """(left, right, copies after minus before, copies after) of the joined rows that a batch changes."""
        moved = [{part for side, part, _ in changes if side == s} for s in (0, 1)]
        sides = [set(self.left) | moved[0], set(self.right) | moved[1]]
        pairs = {(a, b) for a in moved[0] for b in sides[1]} | {(a, b) for b in moved[1] for a in sides[0] | {PAD}}
        emptied = (not self.n) != (not self.n + sum(n for side, _, n in changes if side == (2 if self.mode == TOTALS else 0)))
        if emptied and self.mode != NEVER:
            pairs |= {(PAD, b) for b in sides[1]}
        before = {p: self.copies(*p) for p in pairs}
        for change in changes:
            self.advance(*change)
        for p, was in before.items():
            now = self.copies(*p)
            if now != was:
                yield *p, now - was, now


def _replay(initial: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """A group's cells, each through its batches in order; cells without events give nothing."""
    states: dict[tuple, State] = {}
    todo: dict[tuple, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    columns = ["_key", "_cell", "_mode", "_side", "_batch", "_part", "_n"]
    rows = lambda df: zip(*(df[c].tolist() for c in columns), strict=True) if len(df) else ()  # noqa: E731  a side without rows has no columns
    for key, cell, mode, side, batch, part, n in rows(events):
        states.setdefault((key, cell), State(mode))
        todo[key, cell][batch].append((side, part, n))
    for key, cell, _, side, _, part, n in rows(initial):
        if state := states.get((key, cell)):
            state.advance(side, part, n)
    out = [(batch, key, *row) for (key, cell), batches in todo.items() for batch in sorted(batches) for row in states[key, cell].step(batches[batch])]
    return pd.DataFrame(out, columns=["batch", "_key", "left_part", "right_part", "weight", "total"]).astype({"batch": "int32", "_key": object, "left_part": object, "right_part": object, "weight": "int64", "total": "int64"})


def right_outer_changes(left: DataFrame, right: DataFrame, cell_entries: int = CELL_ENTRIES, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """(batch, key, left_part, right_part, weight, total): what each batch changes in the right outer join on `key`.

    left and right: (batch int, key string, part string, n long): n copies of a row with this part are added to the key,
    or taken away if n is below 0; batch 0 holds the initial rows. weight is the copies of a joined row after the batch
    minus those before, total those after; a right row of a key without left rows has `-` as its left part. A null key
    meets nothing, so its right rows are padded. A left part that is `-` itself prints like a padded one and counts with
    it. Empty sides and batches give no rows.

    Copies of equal rows are summed map-side before anything is dealt, so a key's size is its distinct parts. Cells are
    co-partitioned by key, initial rows and events apart, and each group's Counters are advanced batch by batch. A key
    with more entries than a cell holds is a grid of cells: each left part meets each part of the right in one of them, and
    padding is done in cells that hold the right's parts and the key's left totals. Cells share groups by hash, of about
    group_entries, so that tasks are alike. Counts of entries are all that comes to the driver.
    """
    spark = left.sparkSession
    columns = ["_key", "_side", "_batch", "_part"]
    given = [df.select(F.col("key").alias("_key"), F.lit(side).cast("int").alias("_side"), F.col("batch").cast("int").alias("_batch"), F.col("part").alias("_part"), F.col("n").alias("_n")) for side, df in enumerate((left, right))]
    entries = given[0].where("_key IS NOT NULL").union(given[1]).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    entries = materialise(entries, "join_entries")
    of_side = lambda s: F.count_if(F.col("_side") == s)
    large = entries.groupBy("_key").agg(of_side(0).alias("_l"), of_side(1).alias("_r")).where(F.greatest("_l", "_r") > cell_entries)
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / cell_entries)).cast("int")
    large = materialise(large.select("_key", parts("_l").alias("_a"), parts("_r").alias("_b")), "join_large")
    cells = _cells(entries, large, large.isEmpty())
    groups = max(1, -(-entries.count() // group_entries))
    dealt = cells.withColumn("_group", F.pmod(F.xxhash64("_key", "_cell"), F.lit(groups)).cast("int"))
    events = dealt.where("_batch > 0").select(*(F.col(c).alias(c) for c in dealt.columns))  # columns of its own, which cogroup() tells apart
    found = dealt.where("_batch = 0").groupBy("_group").cogroup(events.groupBy("_group")).applyInPandas(_replay, f"batch int, _key {dict(entries.dtypes)['_key']}, left_part string, right_part string, weight long, total long")
    out = materialise(found.withColumnRenamed("_key", "key"), "join_changes")
    discard(entries, large)
    return out


def _cells(entries: DataFrame, large: DataFrame, none: bool) -> DataFrame:
    """Entries with the cells they go to. Key strings are dealt as they are, so that a null key is a key like others."""
    whole = lambda df: df.select("_key", F.lit(0).alias("_cell"), F.lit(OWN).alias("_mode"), "_side", "_batch", "_part", "_n")
    if none:
        return whole(entries)
    same = entries["_key"].eqNullSafe(large["_key"])
    small = entries.join(large, same, "left_anti")
    cut = entries.join(large, same).drop(large["_key"])
    at = lambda n: F.pmod(F.xxhash64("_part"), F.col(n)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda i: F.struct((at("_a") * F.col("_b") + i).alias("_cell"), F.lit(NEVER).alias("_mode")))
    columns = F.transform(F.sequence(F.lit(0), F.col("_a") - 1), lambda i: F.struct((i * F.col("_b") + at("_b")).alias("_cell"), F.lit(NEVER).alias("_mode")))
    pads = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda i: F.struct((-1 - i).alias("_cell"), F.lit(TOTALS).alias("_mode")))
    own = F.array(F.struct((-1 - at("_b")).alias("_cell"), F.lit(TOTALS).alias("_mode")))
    where = F.when(F.col("_side") == 1, F.concat(columns, own)).when(F.col("_part") == PAD, pads).otherwise(rows)
    totals = cut.where("_side = 0").groupBy("_key", "_batch", "_b").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    totals = totals.select("_key", F.lit(2).alias("_side"), "_batch", F.lit(None).cast("string").alias("_part"), "_n", F.explode(pads).alias("_x"))
    spread = cut.select("_key", "_side", "_batch", "_part", "_n", F.explode(where).alias("_x")).union(totals)
    return whole(small).union(spread.select("_key", "_x._cell", "_x._mode", "_side", "_batch", "_part", "_n"))


def _deltas(rows: DataFrame, prefix: str, batches: int, key_moves: bool, part) -> DataFrame:
    """(batch, key, part, n) of rows (id, ...) that the rule of the contract changes; part(updates) prints a row."""
    drawn = lambda t: F.crc32(F.concat(F.lit(f"{prefix}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f":{t}")).cast("binary"))
    third = F.expr("id div 3 - CASE WHEN id < 0 AND id % 3 <> 0 THEN 1 ELSE 0 END")
    state = rows.withColumns({"p0": drawn(0) % 3 != 0, "u0": F.lit(0), "key": third})
    for t in range(1, batches + 1):
        was, rest = F.col(f"p{t - 1}"), drawn(t) % 19
        state = state.withColumns({f"p{t}": was != (rest == 0), f"u{t}": F.col(f"u{t - 1}") + (was & (rest == 1)).cast("int")})

    def row(t: int, s: int, n: int) -> Column:
        updates = F.col(f"u{s}")
        return F.struct(F.lit(t).alias("batch"), (F.col("key") + updates if key_moves else F.col("key")).alias("key"), part(updates).alias("part"), F.lit(n).cast("long").alias("n"))

    changes = [F.when(F.col("p0"), row(0, 0, 1))]
    for t in range(1, batches + 1):
        moved = (F.col(f"p{t}") != F.col(f"p{t - 1}")) | (F.col(f"u{t}") != F.col(f"u{t - 1}"))
        changes += [F.when(moved & F.col(f"p{t - 1}"), row(t, t - 1, -1)), F.when(moved & F.col(f"p{t}"), row(t, t, 1))]
    return state.select(F.explode(F.array_compact(F.array(*changes))).alias("x")).select("x.*")


def op12_join(spark, sf_dir: str, batches: int = 2) -> DataFrame:
    """batch, join_key, doc_part, label_part, weight, total. An id that is null draws as `null` and has a null key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality", "toxic")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    left = _deltas(docs, "d", batches, True, lambda _: shown(F.col("lang")))
    turned = lambda u: F.when(u % 2 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    right = _deltas(labels, "l", batches, False, lambda u: F.concat(shown(turned(u)), F.lit(","), shown(F.col("toxic"))))
    found = right_outer_changes(*(df.withColumn("key", F.col("key").cast("string")) for df in (left, right)))
    return found.select("batch", F.col("key").cast("long").alias("join_key"), F.col("left_part").alias("doc_part"), F.col("right_part").alias("label_part"), "weight", "total")


def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


def _states(table: str, prefix: str, columns: str) -> str:
    drawn = lambda t: _crc32(f"'{prefix}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{t}'")
    return f"""SELECT *, u1 + CAST(p1 AND r2 = 1 AS INT) AS u2, p1 <> (r2 = 0) AS p2 FROM (SELECT *, CAST(p0 AND r1 = 1 AS INT) AS u1, p0 <> (r1 = 0) AS p1 FROM (
    SELECT CAST(floor(doc_id / 3) AS BIGINT) AS k, {columns}, {drawn(0)} % 3 <> 0 AS p0, {drawn(1)} % 19 AS r1, {drawn(2)} % 19 AS r2 FROM {table}))"""


def _at(t: int) -> str:
    u = "0" if not t else f"u{t}"
    return f"""SELECT {t} AS batch, r.k AS join_key, CASE WHEN l.k IS NULL THEN '-' ELSE coalesce(l.lang, 'null') END AS doc_part,
    coalesce(CAST(CASE WHEN r.{u if t else 'p0'} % 2 = 1 THEN 1 - quality ELSE quality END AS VARCHAR), 'null') || ',' || coalesce(CAST(toxic AS VARCHAR), 'null') AS label_part
    FROM (SELECT k + {u} AS k, lang FROM d WHERE p{t}) l RIGHT JOIN (SELECT * FROM l WHERE p{t}) r ON l.k = r.k""".replace("r.p0 % 2 = 1", "false")


OP12_SQL = f"""
WITH d AS ({_states("documents", "d", "lang")}), l AS ({_states("labels", "l", "quality, toxic")}),
s AS (SELECT batch, join_key, doc_part, label_part, count(*) AS n FROM ({_at(0)} UNION ALL {_at(1)} UNION ALL {_at(2)}) GROUP BY ALL),
c AS (SELECT batch, join_key, doc_part, label_part, n AS weight, n AS total FROM s WHERE batch > 0
  UNION ALL SELECT batch + 1, join_key, doc_part, label_part, -n, 0 FROM s WHERE batch < 2)
SELECT batch, join_key, doc_part, label_part, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(total) AS BIGINT) AS total
FROM c GROUP BY batch, join_key, doc_part, label_part HAVING sum(weight) <> 0
"""
