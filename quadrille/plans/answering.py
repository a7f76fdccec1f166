"""Questions to checked queries: a writer (any text model, as a callback) proposes SQL, execution decides, and evidence
from the data goes into the next attempt."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from quadrille.plans import sqltext

#: Asked for a query: (question with or without hints, remarks of earlier attempts as (query, what was wrong), temperature).
Writer = Callable[[str, list[tuple[str, str]], float], str]
#: Tells what is wrong with a query, or None: sqltext.outcome() with a session.
Execute = Callable[[str], str | None]

MOST_SHOWN = 400


@dataclass
class Answer:
    query: str
    error: str | None
    remarks: list[tuple[str, str]] = field(default_factory=list)
    calls: int = 0


def hint_text(codes: dict[str, list[tuple[str, str]]], periods: list[str]) -> str:
    """Lines to add to a question: for each dimension its likely codes with labels, and the periods that it names."""
    lines = [f"- {d}: " + ", ".join(f"'{c}' ({label})" if label else f"'{c}'" for c, label in found) for d, found in codes.items() if found]
    lines += [f"- periods: {', '.join(periods)}"] if periods else []
    return "\n\nLikely codes:\n" + "\n".join(lines) if lines else ""


def evidence_text(sql: str, valid: Callable[[str], list[tuple[str, str]]], most_columns: int = 3, most_codes: int = 20) -> str:
    """The values that the data has for the columns that a failed query filters, with labels where there are any."""
    lines = []
    for column in list(sqltext.in_lists(sql))[:most_columns]:
        if codes := valid(column)[:most_codes]:
            lines.append(f"- {column}: " + ", ".join(f"'{c}' ({label})" if label else f"'{c}'" for c, label in codes))
    return "The data has these values:\n" + "\n".join(lines) if lines else ""


def pruned_text(sql: str, known: dict[str, list[str]], is_time: Callable[[str], bool] = lambda code: bool(re.fullmatch(r"\d{4}(JJ|KW|MM)\d{2}", code))) -> str:
    """The query with IN lists cut down to the known codes of their column. Lists of unknown columns, lists that would
    become empty and lists of periods stay."""
    spans = [(m.group(), m.start(), m.end()) for m in sqltext._TOKEN.finditer(sql) if not m.group().isspace() and not m.group().startswith(("--", "/*"))]
    texts, out, copied = [t for t, _, _ in spans], [], 0
    for at in range(1, len(texts) - 1):
        if texts[at].upper() != "IN" or texts[at + 1] != "(":
            continue
        end = sqltext._group(texts, at + 1)
        literals = [t for t in texts[at + 2 : end] if t != ","]
        allowed = known.get(sqltext._name(texts[at - 1]))
        if not literals or not allowed or any(t[:1] != "'" for t in literals) or any(is_time(t[1:-1]) for t in literals):
            continue
        kept = [t for t in literals if t[1:-1].replace("''", "'") in allowed]
        if kept and len(kept) < len(literals):
            out += [sql[copied : spans[at + 1][2]], ", ".join(kept)]
            copied = spans[end][1]
    return "".join([*out, sql[copied:]])


def answer(question: str, write: Writer, execute: Execute, hints: str = "", evidence: Callable[[str], str] = lambda sql: "", candidates: int = 1, temperature: float = 0.7, retries: int = 2, retry_plain: bool = True, finish: Callable[[str], str] = lambda sql: sql, on_event: Callable[[str, dict], None] = lambda name, facts: None) -> Answer:
    """The first query that gives rows. With several candidates, the longest one that does; if none does, the first one's
    error is the first remark. Each failed attempt adds a remark with evidence; after the first failure the question is
    also tried without hints. `finish` prunes the codes of whatever is given back, the last attempt if none succeeds."""
    out = Answer("", None)

    def attempt(text: str, remarks: list[tuple[str, str]], heat: float = 0.0) -> tuple[str, str | None]:
        out.calls += 1
        sql = write(text, list(remarks), heat).strip()
        error = execute(sql) if sql else "no query"
        on_event("tried", {"query": sql, "error": error})
        return sql, error

    def done(sql: str, error: str | None) -> Answer:
        out.query, out.error = finish(sql) if sql else "", error
        return out

    if candidates > 1:
        tried = [x for x in (attempt(question + hints, [], temperature) for _ in range(candidates)) if x[0]]
        if good := [sql for sql, error in tried if error is None]:
            return done(max(good, key=len), None)
        out.remarks += [(tried[0][0][:MOST_SHOWN], tried[0][1])] if tried else []
    for k in range(retries + 1):
        sql, error = attempt(question + hints, out.remarks)
        if error is None or not sql or k == retries:
            break
        if k == 0 and retry_plain and hints:
            plain, wrong = attempt(question, [])
            if wrong is None:
                return done(plain, None)
        out.remarks.append((sql[:MOST_SHOWN], "\n".join(filter(None, [error, evidence(sql)]))))
    return done(sql, error)
