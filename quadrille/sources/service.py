"""A statistics service over HTTP as a Spark data source: version 4 gives observations, version 3 wide rows."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urljoin, urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "statistics_service"


def _quoted(code: str) -> str:
    return "'" + code.replace("'", "''") + "'"


#: Codes of a request: longer lists are several requests, and so partitions.
CODES = 100
#: What a filter of Spark is called in a request.
_SIGNS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}


def urls(request: dict, filters: list[str] | None = None, measures: list[str] | None = None) -> list[str]:
    """The requests that together give the table, a partition each. Version 4 asks for each measure on its own, and for at most
    CODES codes of the longest list at a time; version 3 compares codes as substrings, as that service does, so that lists
    that overlap stay in one request. `filters` hold besides, and `measures` are those of the request that are wanted."""
    dims = {g: c for g, c in request["dims"].items() if c}
    root = f"{request['base'].rstrip('/')}/{request['table']}"
    measures = request["measures"] if measures is None else measures
    if request["version"] == 4:
        longest = max(dims, key=lambda g: len(dims[g]), default=None)
        parts = [dims[longest][i : i + CODES] for i in range(0, len(dims[longest]), CODES)] if longest else [None]
        lists = [[f"{g} in ({', '.join(map(_quoted, part if g == longest else codes))})" for g, codes in dims.items()] for part in parts]
        return [f"{root}/Observations?$filter=" + quote(" and ".join([f"Measure in ({_quoted(m)})", *wanted, *(filters or [])])) for m in measures for wanted in lists]
    wanted = ["(" + " or ".join(f"substringof({_quoted(c)},{g})" for c in codes) + ")" for g, codes in dims.items()] + (filters or [])
    columns = "$select=" + quote(",".join(["ID", *request["dims"], *request["measures"]]))
    return [f"{root}/TypedDataSet?" + (f"$filter={quote(' and '.join(wanted))}&" if wanted else "") + columns]


def fetch(url: str, trusted: list[str], retries: int = 3, wait: float = 3.0, timeout: float = 10.0) -> dict | None:
    """The JSON at a URL of a trusted host (or a part of one); None if the service has none. Time-outs and 429 are tried
    again after a wait; when all tries fail the error is raised, so that Spark tries the task again."""
    host = urlsplit(url).hostname or ""
    if not any(host == t or host.endswith("." + t) for t in trusted):
        raise PermissionError(f"{host} is not a trusted host")
    for left in range(retries - 1, -1, -1):
        try:
            with urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except HTTPError as e:
            if e.code != 429:
                return None
            failure = e
        except (TimeoutError, URLError) as e:
            if not isinstance(e, TimeoutError) and not isinstance(e.reason, TimeoutError):
                raise
            failure = e
        if left:
            time.sleep(wait)
    raise failure


class _Reader(DataSourceReader):
    """Filters on dimensions, on the measure and on values go into the requests; Spark still holds all of them, as the service may
    compare more loosely."""

    def __init__(self, request: dict) -> None:
        self.request, self.filters, self.measures = request, [], list(request["measures"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if name == "Measure" and self.request["version"] == 4 and values is not None:
                self.measures = [m for m in self.measures if m in values]
            elif name in self.request["dims"] and values and all(isinstance(v, str) for v in values):
                four = f"{name} in ({', '.join(map(_quoted, values))})"
                three = "(" + " or ".join(f"substringof({_quoted(v)},{name})" for v in values) + ")"
                self.filters.append(four if self.request["version"] == 4 else three)
            elif (name == "Value" if self.request["version"] == 4 else name in self.measures) and type(f) in _SIGNS and isinstance(f.value, (int, float)) and math.isfinite(f.value):
                self.filters.append(f"{name} {_SIGNS[type(f)]} {f.value!r}")
        return filters

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in urls(self.request, self.filters, self.measures)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        r, url = self.request, partition.value
        measures = ["Value"] if r["version"] == 4 else r["measures"]
        names = [*r["dims"], *(["Measure"] if r["version"] == 4 else [])]
        while url:
            page = fetch(url, r["trusted"], r["retries"], r["wait"], r["timeout"]) or {}
            for row in page.get("value", []):
                yield (*(None if row.get(n) is None else str(row[n]) for n in names), *(None if row.get(m) is None else float(row[m]) for m in measures))
            following = page.get("@odata.nextLink") or page.get("odata.nextLink")
            url = urljoin(url, following) if following else None


class StatisticsService(DataSource):
    """Option `request`: JSON of base, table, version, measures, dims (group -> codes), trusted, retries, wait, timeout."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        r = json.loads(self.options["request"])
        last = "Measure string, Value double" if r["version"] == 4 else ", ".join(f"`{m}` double" for m in r["measures"])
        return ", ".join([*(f"`{g}` string" for g in r["dims"]), last])

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["request"]))


def service(spark: SparkSession, base: str, table: str, measures: list[str], dims: dict[str, list[str]], version: int = 4, trusted: tuple[str, ...] | None = None, retries: int = 3, wait: float = 3.0, timeout: float = 10.0) -> DataFrame:
    """A table of the service. Codes are filtered there; an empty list of codes takes all. Only trusted hosts are asked:
    that of `base`, unless others are given. Pages are followed lazily, one request at a time for each partition. What a
    later where() asks of codes, the measure and values goes to the service too; this sets a session's setting that is off
    by default. Columns are chosen by the arguments alone, as sources in Python aren't told of a select()."""
    if version not in (3, 4) or not measures:
        raise ValueError("version is 3 or 4, and measures must be given")
    request = {"base": base, "table": table, "version": version, "measures": measures, "dims": dims, "trusted": trusted or [urlsplit(base).hostname], "retries": retries, "wait": wait, "timeout": timeout}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatisticsService)
    return spark.read.format(NAME).option("request", json.dumps(request)).load()


def sparql(spark: SparkSession, endpoint: str, query: str, trusted: tuple[str, ...] | None = None, retries: int = 3, wait: float = 3.0, timeout: float = 60.0) -> DataFrame:
    """The solutions of a SELECT at an endpoint that answers in JSON, as strings; an unbound variable is null. The answer
    comes through the driver, so queries should be those of catalogs."""
    from urllib.parse import urlencode

    url = f"{endpoint}{'&' if '?' in endpoint else '?'}{urlencode({'query': query, 'format': 'json'})}"
    found = fetch(url, list(trusted or [urlsplit(endpoint).hostname]), retries, wait, timeout) or {}
    names = found.get("head", {}).get("vars", [])
    rows = [tuple(b.get(n, {}).get("value") for n in names) for b in found.get("results", {}).get("bindings", [])]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)) if names else spark.createDataFrame([], "solution string")
