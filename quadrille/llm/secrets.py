"""Operator 2: secrets by fixed formats and by probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_batches, others_of, plus

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
#: Candidates are whole runs of these.
_RUN_BYTES = np.zeros(256, np.bool_)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: Symbols of the shortest base match that is looked for in runs, an access key.
LEAST_BASE = 16
END = ""


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: counts of symbols and ends by state, and where each symbol leads."""

    counts: list[dict[str, int]] = field(default_factory=lambda: [{}])
    edges: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def total(self, q: int) -> int:
        return sum(self.counts[q].values())

    def log2_likelihood(self, text: str, alphabet: int, smooth: float = 0.05) -> float:
        """Bits, smoothed so that an unseen symbol is unlikely but possible; after one, the automaton starts anew."""
        q, out = 0, 0.0
        for c in text:
            n = self.counts[q]
            out += log2((n.get(c, 0) + smooth) / (self.total(q) + smooth * (alphabet + 1)))
            q = self.edges[q].get(c, 0)
        return out + log2((self.counts[q].get(END, 0) + smooth) / (self.total(q) + smooth * (alphabet + 1)))


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """ALERGIA (Carrasco and Oncina): the samples' prefix tree, whose states merge, red with blue in order, where the
    Hoeffding bound finds their ends and symbols equally frequent, recursively. Repeats weigh; no samples, one state."""
    a = Automaton()
    for s in samples:
        q = 0
        for c in s:
            a.counts[q][c] = a.counts[q].get(c, 0) + 1
            if c not in a.edges[q]:
                a.edges[q][c] = len(a.edges)
                a.counts.append({})
                a.edges.append({})
            q = a.edges[q][c]
        a.counts[q][END] = a.counts[q].get(END, 0) + 1
    bound = sqrt(0.5 * log(2 / alpha))

    def alike(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = a.total(p), a.total(q)
            if n and m:
                wide = bound * (1 / sqrt(n) + 1 / sqrt(m))
                if any(abs(a.counts[p].get(c, 0) / n - a.counts[q].get(c, 0) / m) > wide for c in {*a.counts[p], *a.counts[q]}):
                    return False
                todo += [(a.edges[p][c], a.edges[q][c]) for c in a.edges[p].keys() & a.edges[q].keys()]
        return True

    def fold(p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            for c, n in a.counts[q].items():
                a.counts[p][c] = a.counts[p].get(c, 0) + n
            for c, t in a.edges[q].items():
                if c in a.edges[p]:
                    todo.append((a.edges[p][c], t))
                else:
                    a.edges[p][c] = t

    red = [0]
    while True:
        known = set(red)
        blue = next(((p, c) for p in red for c in sorted(a.edges[p]) if a.edges[p][c] not in known), None)
        if not blue:
            break
        q = a.edges[blue[0]][blue[1]]
        for p in red:
            if alike(p, q):
                a.edges[blue[0]][blue[1]] = p
                fold(p, q)
                break
        else:
            red.append(q)
    at = {q: i for i, q in enumerate(red)}
    return Automaton([a.counts[q] for q in red], [{c: at[t] for c, t in a.edges[q].items()} for q in red])


def labelled_credentials(per_kind: int = 150, seed: int = 11) -> list[tuple[str, str]]:
    """(kind, credential): invented credentials in public formats, drawn with a fixed seed. Kinds that
    begin with `plain` are the background: long words, capitals, paths, numbers, and what is random but no secret, such as
    UUIDs, digests in capitals, encoded content and names of built files."""
    rnd = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda letters, n: "".join(rnd.choices(letters, k=n))
    syllables = "the of and ing tion er en es an re on at ed nd ha to or it is st in ar te ve le al se ne de co me ri li la ro ra ti ma no di si ta na lo be ge ch sch ung heit que eau aux ment ción ado".replace("ó", "o").split()

    word = lambda low=5, high=10: "".join(rnd.choices(syllables, k=rnd.randint(low, high)))
    path = lambda: rnd.choice("/.-_").join(word(1, 4) for _ in range(rnd.randint(3, 6)))
    date = lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}"
    case = lambda x: x.upper() if rnd.random() < 0.3 else x
    makers = {
        "access": lambda: "AKIA" + draw(upper + "234567", 16),
        "forge": lambda: rnd.choice(("ghp_", "gho_", "ghs_")) + draw(upper + lower + digit, 36),
        "chat": lambda: f"xox{rnd.choice('bp')}-{draw(digit, 12)}-{draw(digit, 12)}-{draw(upper + lower + digit, 24)}",
        "pay": lambda: rnd.choice(("sk_live_", "rk_live_")) + draw(upper + lower + digit, 24),
        "maps": lambda: "AIza" + draw(upper + lower + digit + "-_", 35),
        "hex": lambda: draw(digit + "abcdef", rnd.choice((32, 40, 64))),
        "plain-word": word,
        "plain-sentence": lambda: word(3, 6) + "." + rnd.choice(("", word(2, 4))),
        "plain-capitals": lambda: word().upper(),
        "plain-path": path,
        "plain-rule": lambda: rnd.choice("-=_./") * rnd.randint(16, 60),
        "plain-number": lambda: draw(digit, rnd.randint(13, 22)),
        "plain-date": lambda: date() + rnd.choice(("", f".{draw(digit, 6)}", f"-{draw(digit, 8)}")),
        "plain-uuid": lambda: case("-".join(draw(digit + "abcdef", n) for n in (8, 4, 4, 4, 12))),
        "plain-digest": lambda: draw(digit + "ABCDEF", rnd.choice((32, 40, 64))),
        "plain-encoded": lambda: (body := draw(upper + lower + digit + "+/", rnd.randint(24, 200))) + "=" * (-len(body) % 4 % 3),
        "plain-encoded-url": lambda: draw(upper + lower + digit + "-_", rnd.randint(24, 200)),
        "plain-asset": lambda: f"{word(1, 3)}{rnd.choice('.-')}{draw(digit + 'abcdef', rnd.choice((8, 12, 20)))}.{rnd.choice(('js', 'css', 'min.js', 'png'))}",
        "plain-title": lambda: "".join(word(1, 3).title() for _ in range(rnd.randint(2, 5))),
    }
    return [(kind, make()) for kind, make in makers.items() for _ in range(per_kind * (3 if kind.startswith("plain") else 1))]


@dataclass
class Grammar:
    """An automaton for each kind of credential and of background; thresholds in bits."""

    automata: dict[str, Automaton]
    background: list[Automaton]
    alphabet: int
    #: By how many bits a format has to explain a candidate better than any background.
    bits: float = 24.0
    #: Symbols of the shortest candidate: four fifths of the shortest labelled credential, as credentials get cut off.
    shortest: int = 1

    def best(self, text: str) -> tuple[str, float] | None:
        """The kind whose format likelihood exceeds every background's most, and by how many bits, if by enough."""
        if not self.automata:
            return None
        base = max((a.log2_likelihood(text, self.alphabet) for a in self.background), default=-8.0 * len(text))
        kind, own = max(((k, a.log2_likelihood(text, self.alphabet)) for k, a in self.automata.items()), key=lambda x: x[1])
        gain = own - base
        return (kind, gain) if gain >= self.bits else None


def _fitted(by: dict[str, list[str]], background: str, bits: float) -> Grammar:
    made = {kind: infer(values) for kind, values in by.items()}
    alphabet = len({c for values in by.values() for v in values for c in v}) or 1
    shortest = min((len(v) for kind, values in by.items() if not kind.startswith(background) for v in values), default=1) * 4 // 5
    return Grammar({k: a for k, a in made.items() if not k.startswith(background)}, [a for k, a in made.items() if k.startswith(background)], alphabet, bits, max(1, shortest))


def learn(labelled: list[tuple[str, str]], background: str = "plain", least: float = 6.0) -> Grammar:
    """An automaton for each label; without labelled credentials nothing is ever found beside the fixed formats.

    The bits that a candidate has to gain are calibrated on every fifth value of each label, which automata of the others
    score: half way between the 2nd percentile of the credentials and the 99.8th of the background, or `least`. Then
    all values are learned from.
    """
    by: dict[str, list[str]] = {}
    for kind, value in labelled:
        by.setdefault(kind, []).append(value)
    trial = _fitted({k: [v for i, v in enumerate(values) if i % 5] or values for k, values in by.items()}, background, float("-inf"))
    gains: dict[bool, list[float]] = {True: [], False: []}
    for kind, values in by.items():
        gains[kind.startswith(background)] += [found[1] for v in values[::5] if (found := trial.best(v))]
    high, low = (float(np.quantile(gains[plain], q)) if gains[plain] else least for plain, q in ((True, 0.998), (False, 0.02)))
    return _fitted(by, background, max(least, (high + low) / 2))


def base_spans(text: str, runs: list[tuple[int, int]], assigns: bool) -> list[tuple[int, int, str]]:
    """Spans of the fixed formats; access keys and hex numbers lie within single runs, so only runs are searched."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if assigns else []
    for a, b in runs:
        part = text[a:b]
        if "AKIA" in part:
            found += [(a + m.start(), a + m.end(), "access") for m in _ACCESS.finditer(part) if m.end() - m.start() >= 16]
        found += [(a + m.start(), a + m.end(), "hex") for m in _HEX.finditer(part) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find(text: str, runs: list[tuple[int, int]], assigns: bool, grammar: Grammar) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): a run that meets no base span and that a format explains better than the background adds
    `format` spans."""
    base = base_spans(text, runs, assigns)
    # of the base spans that begin before a run ends, the one that ends last tells whether any meets the run
    starts, ends = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
    clear = lambda a, b: not (k := bisect_left(starts, b)) or ends[k - 1] <= a
    added = [(a, b, "format") for a, b in runs if b - a >= grammar.shortest and clear(a, b) and grammar.best(text[a:b])]
    return base, sorted(base + added, key=lambda x: (x[0], (*KINDS, "format").index(x[2])))


def _candidates(column: pa.Array, shortest: int) -> Iterator[tuple[int, str, list[tuple[int, int]], bool]]:
    """(row, text, runs in code points, whether it may hold an assignment) for the rows where anything can be found.
    Runs come from one pass over the batch's UTF-8 bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else at
    edges = np.flatnonzero(np.diff(np.concatenate(([False], _RUN_BYTES[raw], [False])).view(np.int8)))
    if not len(edges):
        edges = np.zeros(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    crossing = np.searchsorted(at, starts, side="right") < np.searchsorted(at, ends - 1, side="right")
    if crossing.any():  # a run over the border of two rows is one in each
        cut = [(max(a, at[r]), min(b, at[r + 1])) for a, b in zip(starts[crossing].tolist(), ends[crossing].tolist(), strict=True) for r in range(int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b - 1, side="right")))]
        starts = np.concatenate((starts[~crossing], [a for a, _ in cut]))
        ends = np.concatenate((ends[~crossing], [b for _, b in cut]))
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], ends[by]
    row = np.searchsorted(at, starts, side="right") - 1
    signs = np.searchsorted(at, np.flatnonzero((raw == 58) | (raw == 61)), side="right") - 1
    signed = np.zeros(len(column) + 1, np.bool_)
    signed[signs] = True
    first = np.searchsorted(row, np.arange(len(column) + 1))
    for r in np.flatnonzero((first[1:] > first[:-1]) | signed[: len(column)]).tolist():
        text = raw[at[r] : at[r + 1]].tobytes()
        runs, code, byte = [], 0, 0
        for a, b in zip((starts[first[r] : first[r + 1]] - at[r]).tolist(), (ends[first[r] : first[r + 1]] - at[r]).tolist(), strict=True):
            code += len(text[byte:a].decode())
            runs.append((code, code + b - a))
            code, byte = code + b - a, b
        yield r, text.decode(), runs, bool(signed[r])


def scan(docs: DataFrame, grammar: Grammar, text_col: str = "text", mask: str | None = None, base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """docs' columns but the text, then base and spans: arrays of (start, end, kind), code points, end exclusive. They
    replace columns of their names.

    With `mask`, the text stays, with every span replaced by it; of overlapping spans the union is replaced once. Null
    and empty texts have no spans and stay as they are. Rows, repeated or not, stay as they are.
    """
    others = others_of(docs, base_col, spans_col, *([text_col] if mask is None else []))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            base, spans, masked = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)], {}
            for r, text, runs, assigns in _candidates(texts, min(LEAST_BASE, shared.value.shortest)):
                base[r], spans[r] = find(text, runs, assigns, shared.value)
                if mask is not None and spans[r]:
                    parts, at = [], 0
                    for a, b, _ in spans[r]:
                        if a >= at:
                            parts += [text[at:a], mask]
                        at = max(at, b)
                    masked[r] = "".join([*parts, text[at:]])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            if masked:
                columns[others.index(text_col)] = pa.array([masked.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
            as_rows = lambda found: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*columns, as_rows(base), as_rows(spans)], names=[*others, base_col, spans_col])

    ddl = ", ".join(f"`{c}` array<struct<start:bigint,end:bigint,kind:string>>" for c in (base_col, spans_col))
    given = docs.select(*others) if mask is not None else docs.select(*others, text_col)
    return map_batches(given, run, plus(docs.select(*others), ddl))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, learn(labelled_credentials()))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
