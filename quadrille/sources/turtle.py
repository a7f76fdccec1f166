"""Turtle and TriG files as rows (s, p, o, g, o_is_literal, o_datatype, o_lang), a file for each task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "s string, p string, o string, g string, o_is_literal boolean, o_datatype string, o_lang string"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[.;,()\[\]{}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _plain(text: str) -> str:
    named = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else named.get(m[3], m[3]), text) if "\\" in text else text


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"no Turtle at {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]
    yield "end", ""


class _Parser:
    """Terms are (value, is_literal, datatype, language). Blank nodes get labels of their file."""

    def __init__(self, text: str, scope: str) -> None:
        self.tokens = _tokens(text)
        self.kind, self.text = next(self.tokens)
        self.prefixes, self.base, self.scope, self.made = {}, "", scope, 0
        self.graph: str | None = None
        self.rows: list[tuple] = []

    def next(self) -> str:
        taken = self.text
        self.kind, self.text = next(self.tokens)
        return taken

    def take(self, sign: str) -> None:
        if self.text != sign:
            raise SyntaxError(f"{sign!r} expected, not {self.text!r}")
        self.next()

    def iri(self) -> str:
        if self.kind == "iri":
            return urljoin(self.base, _plain(self.next()[1:-1]))
        if self.kind == "name":
            prefix, local = self.next().split(":", 1)
            if prefix not in self.prefixes:
                raise SyntaxError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxError(f"an IRI expected, not {self.text!r}")

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def emit(self, s: str, p: str, o: tuple) -> None:
        self.rows.append((s, p, o[0], self.graph, *o[1:]))

    def term(self) -> tuple:
        if self.kind == "text":
            raw = self.next()
            value = _plain(raw[3:-3] if raw[:3] in ('"""', "'" * 3) else raw[1:-1])
            if self.kind == "lang":
                return value, True, None, self.next()[1:]
            if self.text == "^^":
                self.next()
                return value, True, self.iri(), None
            return value, True, None, None
        if self.kind == "number":
            raw = self.next()
            return raw, True, XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"), None
        if self.kind == "word" and self.text in ("true", "false"):
            return self.next(), True, XSD + "boolean", None
        return self.node(), False, None, None

    def node(self) -> str:
        if self.kind == "blank":
            return f"_:{self.scope}{self.next()[2:]}"
        if self.text == "[":
            self.next()
            node = self.blank()
            if self.text != "]":
                self.properties(node)
            self.take("]")
            return node
        if self.text == "(":
            self.next()
            items = []
            while self.text != ")":
                items.append(self.term())
            self.next()
            cells = [self.blank() for _ in items] + [RDF + "nil"]
            for i, item in enumerate(items):
                self.emit(cells[i], RDF + "first", item)
                self.emit(cells[i], RDF + "rest", (cells[i + 1], False, None, None))
            return cells[0]
        return self.iri()

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.next()
                p = RDF + "type"
            else:
                p = self.iri()
            self.emit(s, p, self.term())
            while self.text == ",":
                self.next()
                self.emit(s, p, self.term())
            if self.text != ";":
                return
            while self.text == ";":
                self.next()
            if self.text in (".", "]", "}") or self.kind == "end":
                return

    def block(self) -> None:
        self.take("{")
        while self.text != "}":
            self.statement(inside=True)
        self.next()
        self.graph = None

    def statement(self, inside: bool = False) -> None:
        word = self.text.lower().lstrip("@") if self.kind in ("word", "lang") else ""
        if word in ("prefix", "base"):
            dotted = self.next().startswith("@")
            name = self.next()[:-1] if word == "prefix" else None
            iri = urljoin(self.base, _plain(self.next()[1:-1]))
            if name is None:
                self.base = iri
            else:
                self.prefixes[name] = iri
            if dotted:
                self.take(".")
            return
        if word == "graph":
            self.next()
            self.graph = self.node()
            return self.block()
        if self.text == "{":
            return self.block()
        anonymous = self.text == "["
        s = self.node()
        if self.text == "{" and not inside:
            self.graph = s
            return self.block()
        if not (anonymous and self.text in (".", "}")):
            self.properties(s)
        if not (inside and self.text == "}"):
            self.take(".")

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            self.statement()
        return self.rows


def parse(text: str, scope: str = "") -> list[tuple]:
    """(s, p, o, g, o_is_literal, o_datatype, o_lang) of a Turtle or TriG text; SyntaxError if it is none."""
    return _Parser(text, scope).parse()


def graph(spark: SparkSession, path: str) -> DataFrame:
    """The files at a path as quads. Blank nodes of different files stay apart. A file is parsed whole, so large graphs
    should come in many; N-Quads, which split by lines, are read by sources.tables.quads()."""
    files = spark.read.text(path, wholetext=True).selectExpr("value", "md5(input_file_name()) AS scope")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for part in parts:
            for text, scope in zip(part["value"], part["scope"], strict=True):
                yield pd.DataFrame(parse(text, f"f{scope[:12]}"), columns=names)

    return files.mapInPandas(run, SCHEMA)
