"""Personal data and the terms that give it away, with built-in functions only.

Four kinds are found by pattern: e-mail and IP addresses, card and phone numbers. Then
corpus co-occurrence tells which other words disclose them. For a term t and a kind e,
counted over the lines of all documents,

    disclosure(t, e) = log(p(e | t) / p(e)) / -log p(e)

is the share of e's information that t reveals: 1 if e is on every line with t, 0 if t
says nothing. Terms at or above ``threshold``, on at least ``min_lines`` lines with e, are
spans of kind ``term`` on the lines that hold an e. Sanitising generalises a base span to
its kind and removes disclosing terms (to ``[TERM]``); all other text stays as it is.

Null and empty texts have no spans and stay as they are; equal texts are treated alike;
repeated rows count each. Documents without personal data are never changed. Ids must be
unique. Other columns pass through, except those the operators write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskmine.llm.native import matches
from taskmine.sources.stages import staged

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, MIN_LINES, MIN_LETTERS = 0.8, 10, 3

# \G or a look-behind keeps the search linear: a run that cannot match at its first
# character cannot match at a later one. Possessive parts never need to give back.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_VALID_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_WORD = r"[^\p{L}\p{N}]+"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _of_kind(text: Column, rank: int, pattern: str, gate: Column, valid) -> Column:
    found = F.filter(matches(text, pattern), lambda m: valid(m["match"]))
    shaped = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))
    return F.when(gate, shaped).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """(start, rank, end, kind) of the personal data in a text, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    between = lambda low, high: lambda m: F.length(_digits(m)).between(low, high)
    return F.array_sort(F.concat(
        _of_kind(text, 0, _EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        _of_kind(text, 1, _IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]")), lambda m: F.rlike(m, F.lit(_VALID_IP))),
        _of_kind(text, 2, _CARD, F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){13}")), lambda m: between(14, 19)(m) & _luhn(_digits(m))),
        _of_kind(text, 3, _PHONE, F.contains(text, F.lit("+")), between(10, 15))))


def _words(line: Column) -> Column:
    """Distinct lower-cased words that can be terms."""
    return F.filter(F.array_distinct(F.split(F.lower(line), _WORD)), lambda w: F.length(w) >= MIN_LETTERS)


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: spans found by pattern."""
    return docs.withColumn("base", base_spans(F.col(text)))


def _protected_lines(found: DataFrame, doc_id: str) -> DataFrame:
    """Lines of documents with personal data: their place, where they begin, their text and the kinds on them."""
    lines = found.where(F.size("base") > 0).select(doc_id, "base", F.posexplode(F.split("protected", "\n")).alias("line_no", "line"))
    before = Window.partitionBy(doc_id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    begun = lines.withColumn("begin", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    here = F.filter("base", lambda s: (s["start"] >= F.col("begin")) & (s["start"] < F.col("begin") + F.length("line")))
    return begun.withColumn("kinds", F.array_distinct(F.transform(here, lambda s: s["kind"]))).where(F.size("kinds") > 0).drop("base")


def disclosing_terms(docs: DataFrame, lines: DataFrame, text: str, threshold: float, min_lines: int) -> DataFrame:
    """(term, kind, disclosure) over all documents; every count is an aggregate with partial sums."""
    each = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    of_term = each.select(F.explode(_words(F.col("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("lines"))
    all_lines = docs.agg(F.sum(F.size(F.split(F.col(text), "\n")))).scalar()
    of_kind = lines.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("kind_lines"))
    masked = F.regexp_replace("line", r"[\p{L}\p{N}._%+-]*[@0-9][\p{L}\p{N}._%+@-]*", " ")
    joint = (lines.select(F.explode("kinds").alias("kind"), masked.alias("line")).select("kind", F.explode(_words(F.col("line"))).alias("term"))
             .groupBy("term", "kind").agg(F.count("*").alias("both")).where(F.col("both") >= min_lines))
    rated = joint.join(of_term, "term").join(F.broadcast(of_kind), "kind")  # 4 rows
    share = F.col("kind_lines") / all_lines
    # a kind on every line leaves nothing to disclose
    disclosure = F.try_divide(F.log(F.col("both") / F.col("lines") / share), -F.log(share))
    return rated.withColumn("disclosure", disclosure).where(F.col("disclosure") >= threshold).select("term", "kind", "disclosure")


def term_spans(docs: DataFrame, found: DataFrame, doc_id: str, text: str, threshold: float, min_lines: int) -> DataFrame:
    """doc_id and ``terms``: spans of the disclosing terms on its protected lines."""
    lines = _protected_lines(found, doc_id)
    terms = disclosing_terms(docs, lines, text, threshold, min_lines).select("term", "kind")
    place = [doc_id, "line_no"]
    words = lines.select(*place, F.explode("kinds").alias("kind"), _words(F.col("line")).alias("words")).select(*place, "kind", F.explode("words").alias("term"))
    hit = words.join(terms, ["term", "kind"]).groupBy(*place).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    placed = lines.join(hit, place).select(doc_id, "begin", matches(F.col("line"), pattern).alias("m")).select(doc_id, F.explode("m").alias("m"), "begin")
    span = F.struct((F.col("m.start") + F.col("begin")).cast("int").alias("start"), F.lit(len(KINDS)).alias("rank"),
                    (F.col("m.end") + F.col("begin")).cast("int").alias("end"), F.lit("term").alias("kind"))
    return placed.groupBy(doc_id).agg(F.array_sort(F.collect_list(span)).alias("terms"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, ``base`` and ``spans``: all of them, outside of other base spans, by start, then kind. Runs a job when called."""
    protected = F.when(F.size("base") > 0, F.col("text")).alias("protected")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = staged(detected(plain).select("doc_id", "base", protected), "pii-base")
    terms = term_spans(plain, found, "doc_id", "text", threshold, min_lines)
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    both = F.array_sort(F.concat("base", F.coalesce(free, F.array().cast(_SPANS))))
    return found.drop("protected").join(terms, "doc_id", "left").select("doc_id", "base", both.alias("spans"))


def replaced(text: Column, marks: Column) -> Column:
    """The text with each span generalised to its kind; of overlapping spans the first names the kind."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done, s):
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        gap = F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= done["at"], F.concat(done["out"], gap, label)).otherwise(done["out"]).alias("out"))

    rest = lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(marks) > 0, F.aggregate(marks, state, add, rest)).otherwise(text)


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; rows and columns stay."""
    found = spans(docs, doc_id, text, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    joined = docs.join(found, docs[doc_id] == F.col("_id"), "left")
    return joined.select(*[replaced(docs[text], F.col("_spans")).alias(text) if c == text else docs[c] for c in docs.columns])
