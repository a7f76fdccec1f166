"""Operator 5: personal data by fixed formats and by information-theoretic disclosure, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
#: A term discloses an identifier if it carries this share of the identifier's information.
DISCLOSURE = 0.9
#: Least log-likelihood ratio (G squared, one degree of freedom) of a meeting that is not chance: p < 0.001.
SIGNIFICANCE = 10.83

#: Each pattern finds the base matches leftmost and non-overlapping, without groups that loop (those overflow Java's
#: stack on long runs): U+0001 stands for a separator between two characters of one match, see _prepared().
_EMAIL = r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@(?=[A-Za-z0-9-]++\x01)[A-Za-z0-9\x01-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9\x01])[0-9][0-9\x01]{12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"(?<!\p{L})\p{L}{4,}+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: str, value: Callable[[Column], Column] = lambda match: match) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points: the pieces between matches and the
    matches take turns, so lengths add up to offsets. They are added up in chunks of the root of their number, as an array
    that grows by one is copied each time: n matches cost n ** 1.5 steps at most."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        return _let(start, lambda a: F.struct((a + F.length(pair["match"])).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + F.length(pair["match"])).alias("end"), value(pair["match"]).alias("value")))).alias("out")))

    def in_chunks(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda total, p: total + F.length(p["piece"]) + F.length(p["match"])))
        begins = F.aggregate(sums, F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))"), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), begins.alias("begin")), lambda z: F.aggregate(z["chunk"], F.struct(z["begin"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def of_pairs(pairs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int")), lambda k: F.slice(pairs, k * size + 1, size))
        return F.when(F.size(pairs) > 0, _let(chunks, in_chunks)).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: _let(F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(f)).alias("piece"), f.alias("match")), of_pairs))


def _prepared(text: Column, between: str) -> Column:
    """The text with each separator that `between` matches as U+0001; a U+0001 that is there becomes U+0002."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), between, "\x01")


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(i)).otherwise(doubled(at(i))))
    return n.between(13, 19) & (total % 10 == 0)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, value, kind>> of all base matches, by kind as listed, then start; kind is its place. The value
    of a card is its digits."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    has_digit = text.rlike("[0-9]")
    found = {
        "email": F.when(F.instr(text, "@") > 0, spans_of(_prepared(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"), _EMAIL, lambda m: F.translate(m, "\x01", "."))),
        "ip": F.when(has_digit & text.rlike(_IP), F.filter(spans_of(text, _IP), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")))),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(spans_of(_prepared(text, r"(?<=[0-9])[\x20-](?=[0-9])"), _CARD, lambda m: F.translate(m, "\x01", "")), lambda s: _luhn(s["value"]))),
        "phone": F.when(F.instr(text, "+") > 0, F.filter(spans_of(text, _PHONE), lambda s: digits(s["value"]).between(9, 15))),
    }
    of_kind = lambda i: lambda s: F.struct(s["start"], s["end"], s["value"], F.lit(i).alias("kind"))
    return F.concat(*(F.transform(F.coalesce(found[k], none), of_kind(i)) for i, k in enumerate(KINDS)))


def _digest() -> Column:
    """Equal for copies of a text."""
    return F.unhex(F.md5("_text"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _likelihood_ratio(n: Column) -> Column:
    """G squared of the table of `both`, of_term and of_entity among n texts."""
    both, t, e = F.col("both").cast("double"), F.col("of_term").cast("double"), F.col("of_entity").cast("double")
    cells = [(both, t, e), (t - both, t, n - e), (e - both, n - t, e), (n - t - e + both, n - t, n - e)]
    return 2 * sum((F.when(o > 0, o * F.log(o * n / (a * b))).otherwise(0.0) for o, a, b in cells), F.lit(0.0))


def _clear_of_base(terms: DataFrame, base: DataFrame) -> DataFrame:
    """(_digest, terms): the spans (_digest, start, end) of terms that meet no span of `base` in their text, in order. Each
    text's spans are passed over once from either side."""
    both = terms.select("_digest", "start", "end", F.lit(False).alias("is_base")).unionByName(base.select("_digest", "start", "end", F.lit(True).alias("is_base")))
    before = Window.partitionBy("_digest").orderBy("start", F.desc("is_base")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_digest").orderBy(F.desc("start"), F.asc("is_base")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_last", F.max(F.when(F.col("is_base"), F.col("end"))).over(before)).withColumn("_next", F.min(F.when(F.col("is_base"), F.col("start"))).over(after))
    clear = near.where(~F.col("is_base") & (F.coalesce("_last", F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end"))))
    return clear.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, significance: float = SIGNIFICANCE) -> DataFrame:
    """(id, base, terms) for each row: base as base_spans(), terms as array<struct<start, end>> of disclosing terms.

    Identifiers of the base formats are the protected entities. A term (four letters or more) in a document that holds
    one discloses it if log2(p(t, e) / (p(t) p(e))) >= disclosure * -log2 p(e), where p counts distinct texts, and the
    log-likelihood ratio of their meeting is `significance` at least, however rare both are; every occurrence in such a
    document is marked. Documents without identifiers keep all their terms.

    Entities that occur in the same texts meet the same terms, and are one in the counts: so a text with any number of
    identifiers of its own costs its terms once, not once for each.

    Null and empty texts have no spans. Null and repeated ids are rows like any other. No rows, no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    own = rows.withColumn("base", F.transform(base_spans(F.col("_text")), lambda s: F.struct(s["start"], s["end"], s["kind"], F.lower(s["value"]).alias("entity"))))
    own = own.select("_id", _digest().alias("_digest"), "base", F.when(F.size("base") > 0, F.col("_text")).alias("_text"))
    own = materialise(own, "identifiers")
    total = own.select("_digest").distinct().count()
    n = F.lit(float(total))
    holding = own.where(F.size("base") > 0)
    entities = holding.select("_digest", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity")).distinct()
    where = entities.groupBy("entity").agg(F.count("*").alias("of_entity"), F.bit_xor(F.xxhash64("_digest")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(1), "_digest")).alias("_b"))
    together = materialise(entities.join(where, "entity").select("_digest", "of_entity", "_a", "_b").distinct(), "entities")
    texts = rows.select(_digest().alias("_digest"), _terms(F.col("_text")).alias("words")).dropDuplicates(["_digest"])
    words = texts.select(F.explode("words").alias("term"))
    of_term = materialise(words.groupBy("term").agg(F.count("*").alias("of_term")), "of_term")
    once = holding.select("_digest", "_text", "base").dropDuplicates(["_digest"])
    terms = once.select("_digest", F.explode(_terms(F.col("_text"))).alias("term"))
    told_by = lambda both: F.log2(both * n / (F.col("of_term").cast("double") * F.col("of_entity")))
    information = F.log2(n / F.col("of_entity"))
    # a term and an entity meet in as many texts as the entity has, at most: what that can't make disclosing is left out early
    able = (information > 0) & (told_by(F.least("of_term", "of_entity")) >= disclosure * information)
    pairs = materialise(terms.join(of_term, "term").join(together, "_digest").where(able), "pairs")
    met = pairs.groupBy("_a", "_b", "of_entity", "term", "of_term").agg(F.count("*").alias("both"))
    facts = met.where((told_by(F.col("both")) >= disclosure * information) & (_likelihood_ratio(n) >= significance)).select("_a", "_b", "of_entity", "term")
    told = materialise(pairs.join(facts, ["_a", "_b", "of_entity", "term"], "left_semi").select("_digest", "term").distinct(), "told")
    held = once.join(told.select("_digest").distinct(), "_digest", "left_semi")
    places = held.select("_digest", F.explode(spans_of(F.col("_text"), _TERM)).alias("s")).select("_digest", F.lower("s.value").alias("term"), "s.start", "s.end")
    by_text = _clear_of_base(places.join(told, ["_digest", "term"], "left_semi"), held.select("_digest", F.explode("base").alias("s")).select("_digest", "s.start", "s.end"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    marked = own.join(by_text, "_digest", "left")
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["entity"].alias("value"), s["kind"]))
    return marked.select(F.col("_id").alias(id_col), base.alias("base"), F.coalesce("terms", none).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with each base span generalised to its kind in brackets, and each disclosing term to [TERM]."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"], s["end"], names[s["kind"]].alias("by"))), F.transform(terms, lambda s: F.struct(s["start"], s["end"], F.lit("[TERM]").alias("by")))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        added = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        return F.struct(F.when(fresh, added).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, terms)).alias("spans"))
