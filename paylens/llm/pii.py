"""Personal data by expressions and bootstrapped contexts (operator 4), in DataFrame operations only.

*Base kinds* (``email``, ``ip``, ``card``, ``phone``) are expressions with a
check; they seed the search.

*Bootstrapping.*  A candidate is a token, or a run of digit groups joined by
blanks, brackets, dots or hyphens, that holds at least ``MIN_DIGITS`` digits or
an ``@`` between letters or digits.  Its lexical patterns are its contexts: the two words before it, and
the word on either side, wherever other candidates stand.  Base spans, whole,
are seeds of their kind, and so are candidates that reach beyond a base span;
parts of one are no candidates.  Patterns and instances (their values) form a
bipartite graph, scored in ``ROUNDS`` rounds of grouped joins: a pattern's confidence for
a kind is the mean score of its distinct instances (lightly smoothed), and it is
trusted with at least ``MIN_SUPPORT`` instances known for that kind and a
confidence of ``MIN_CONFIDENCE``; an instance seen in trusted patterns scores
``1 - product(1 - confidence)`` and is known from then on if it reaches
``MIN_CONFIDENCE``.  Unlabelled candidates in trusted patterns become spans of
kind ``ctx_<kind>``.  Only the graph is shuffled, never a text; a very common
pattern is an aggregation key and pre-aggregated.

Offsets are code points, end exclusive.  The expressions are possessive and
anchored to the start of a run, equivalent to the plain greedy ones but linear
and without recursion on very long runs.

Results: a NULL text counts as empty and has no spans; rows without id or with
a repeated id keep their own spans; redaction leaves other columns untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import written

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 5, 3, 0.8, 3

SPAN = "struct<kind:string,start:bigint,stop:bigint>"

# kind → (expression, sign of its presence, check of a match)
_EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGNS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"),
    "card": _is_card,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """Sum of the elements before each element of a non-empty array.

    Built from sums of blocks of sqrt(n) elements: n * sqrt(n) steps, so that a
    text with very many matches does not take quadratic time.
    """
    def blocked(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")),
                           lambda k: _total(F.slice(x, k * width + 1, width)))
        before = _let(sums, lambda t: F.transform(t, lambda _, k: _total(F.slice(t, F.lit(1), k))))
        at = lambda i: F.floor(i / width).cast("int")
        return _let(before, lambda t: F.transform(
            x, lambda _, i: F.get(t, at(i)) + _total(F.slice(x, at(i) * width + 1, i - at(i) * width))))
    return _let(numbers, blocked)


def matches(text: Column, expression: str, sign: Column) -> Column:
    """``array<struct<value, start, stop, before, after>>`` of all leftmost non-overlapping matches.

    The matches and the gaps around them alternate, so running lengths give offsets.
    """
    empty = F.array().cast("array<struct<value:string,start:bigint,stop:bigint,before:string,after:string>>")

    def placed(value: Column, gaps: Column) -> Column:
        n = F.size(value)
        sizes = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("g"), value.alias("v")),
                            lambda z: (F.length(z["g"]) + F.length(z["v"])).cast("bigint"))
        row = F.arrays_zip(value.alias("value"), F.slice(gaps, F.lit(1), n).alias("before"),
                           F.slice(gaps, F.lit(2), n).alias("after"), sums_before(sizes).alias("at"))

        def span(z: Column) -> Column:
            start = z["at"] + F.length(z["before"])
            return F.struct(z["value"].alias("value"), start.alias("start"),
                            (start + F.length(z["value"])).alias("stop"), z["before"].alias("before"),
                            z["after"].alias("after"))
        return F.when(n > 0, F.transform(row, span)).otherwise(empty)

    found = _let(F.regexp_extract_all(text, F.lit(expression), F.lit(0)),
                 lambda value: _let(F.split(text, expression, -1), lambda gaps: placed(value, gaps)))
    return F.when(sign, found).otherwise(empty)


def _valued_spans(text: Column) -> Column:
    """The base spans with their ``value``, by kind as listed, then start."""
    def of(kind: str) -> Column:
        m = matches(text, _EXPRESSIONS[kind], _SIGNS[kind](text))
        return F.transform(F.filter(m, lambda x: _CHECKS[kind](x["value"])), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    return F.concat(*[of(kind) for kind in KINDS])


def base_spans(text: Column) -> Column:
    """``array<SPAN>`` of the base kinds, by kind as listed, then start."""
    return F.transform(_valued_spans(text), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))


# digits joined by dots and hyphens that are no part of a longer token
_GROUP = r"[0-9]++(?:[.-][0-9]++)*+(?![.-]*+[A-Za-z@_%+/:#]|[.-][.-]++[0-9])"
_BRACKETED = r"\([0-9]++\)[\x20.-]?+"
_RUN = rf"\+?+(?:{_BRACKETED})?+{_GROUP}(?:\x20{_GROUP}|[\x20.-]?+{_BRACKETED}{_GROUP})*+"
_TOKEN = (rf"(?:\G|(?<![A-Za-z0-9@._%+/:#-]))(?:{_RUN}|[A-Za-z._%+/:#-]*+[0-9@][0-9A-Za-z@._%+/:#-]*+)")

AROUND, BLOCK = 80, 256  # code points of context on either side; of a block, at least AROUND


def _blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, so that a context is cut without walking the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def _cut(blocks: Column, at: Column, length: Column) -> Column:
    """``length`` code points, at most ``BLOCK``, from offset ``at``."""
    k = F.floor(at / BLOCK).cast("int")
    piece = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    return F.substr(F.concat(piece(k), piece(k + 1)), (at - k * BLOCK + 1).cast("int"), length.cast("int"))


def candidates(rows: DataFrame) -> DataFrame:
    """``(row, value, start, stop, kind, pattern)`` of ``(row, text, base)`` rows.

    One row per instance and pattern: the base spans with their kind, and the
    candidates that are not inside one, with the kind that they overlap, or NULL.
    """
    def enough(value: Column) -> Column:
        return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= MIN_DIGITS) | value.rlike("[0-9A-Za-z]@[0-9A-Za-z]")

    def others(base: Column) -> Column:
        m = matches(F.col("text"), _TOKEN, F.col("text").rlike("[0-9@]"))
        cut = F.transform(m, lambda x: F.struct(F.rtrim(x["value"], F.lit(".:-/%#_+")).alias("value"), x["start"].alias("start")))
        spans = F.transform(F.filter(cut, lambda x: enough(x["value"])), lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value")))
        free = F.filter(spans, lambda x: ~F.exists(base, lambda s: (s["start"] <= x["start"]) & (s["stop"] >= x["stop"])))
        over = lambda x: F.filter(base, lambda s: (s["start"] < x["stop"]) & (s["stop"] > x["start"]))
        return F.transform(free, lambda x: F.struct(
            F.get(over(x)["kind"], F.lit(0)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
            x["value"].alias("value")))

    def placed(blocks: Column, x: Column) -> Column:
        first = F.greatest(x["start"] - AROUND, F.lit(0))
        return F.struct(F.lower(x["value"]).alias("value"), x["start"].alias("start"), x["stop"].alias("stop"),
                        x["kind"].alias("kind"), _cut(blocks, first, x["start"] - first).alias("before"),
                        _cut(blocks, x["stop"], F.lit(AROUND)).alias("after"))

    # only the short structs are exploded, neither the text nor its blocks
    both = _let(F.col("base"), lambda base: F.concat(base, others(base)))
    found = _let(_blocks(F.col("text")), lambda blocks: F.transform(both, lambda x: placed(blocks, x)))
    x = rows.select("row", F.explode(found).alias("c")).select("row", "c.*")
    left = F.split(F.lower(F.btrim("before")), r"\s+")
    right = F.split(F.lower(F.btrim("after")), r"\s+")
    l1, l2 = F.element_at(left, -1), F.try_element_at(left, F.lit(-2))
    r1 = F.element_at(right, 1)
    patterns = F.array(
        F.when((l1 != "") & l2.isNotNull(), F.concat_ws(" ", l2, l1, F.lit("_"))),
        F.when((l1 != "") & (r1 != ""), F.concat_ws(" ", l1, F.lit("_"), r1)))
    return x.select("row", "value", "start", "stop", "kind", F.explode(F.array_compact(patterns)).alias("pattern"))


def trusted_patterns(found: DataFrame) -> DataFrame:
    """``(pattern, kind, confidence)`` after ``ROUNDS`` rounds over the pattern-instance graph."""
    graph = written(found.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-graph")
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = graph.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    known, trusted = seeds, None
    for _ in range(ROUNDS):
        sums = graph.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(
            F.sum("score").alias("s"), F.count(F.lit(1)).alias("support"))
        trusted = sums.where(F.col("support") >= MIN_SUPPORT).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("s") / (F.col("n") + 0.1)).alias("confidence"))
        trusted = written(trusted.where(F.col("confidence") >= MIN_CONFIDENCE), "pii-patterns")
        new = graph.where("kind is null").select("pattern", "value").join(trusted, "pattern").groupBy(
            "value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        known = seeds.unionByName(new.where(F.col("score") >= MIN_CONFIDENCE))
    return trusted


def discovered(found: DataFrame) -> DataFrame:
    """``(row, spans)``: candidates outside base spans that stand in trusted patterns."""
    best = trusted_patterns(found).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    hits = found.where("kind is null").join(best, "pattern").groupBy("row", "start", "stop").agg(
        F.max("b").alias("b"))
    return hits.groupBy("row").agg(F.collect_list(F.struct(
        F.concat(F.lit("ctx_"), "b.kind").alias("kind"), "start", "stop")).alias("more"))


def pii_spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``, the array of all spans: base kinds as listed, then ``ctx_`` kinds, by start."""
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))  # equal texts have equal spans
    rows = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", _valued_spans(F.col("text")))
    found = written(candidates(rows).distinct(), "pii-candidates")
    more = discovered(found).withColumnsRenamed({"row": "_pii_row", "more": "_pii_more"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.withColumn("_pii_key", row).withColumn("_pii_base", base_spans(text))
    x = x.join(more, F.col("_pii_key") == F.col("_pii_row"), "left")
    ranked = F.transform(F.coalesce("_pii_more", F.array().cast(f"array<{SPAN}>")), lambda s: F.struct(
        F.array_position(F.array(*[F.lit("ctx_" + k) for k in KINDS]), s["kind"]).alias("i"), s["start"].alias("start"),
        s["stop"].alias("stop"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                                   s["stop"].alias("stop")))
    return x.withColumn(out, F.concat("_pii_base", ordered)).drop("_pii_key", "_pii_base", "_pii_row", "_pii_more")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"),
                                                               s["kind"].alias("kind"))))

    def cut(acc: Column, s: Column) -> Column:
        mark = F.concat(F.substr(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")),
                        F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"),
                        F.concat(acc["out"], F.when(s["start"] >= acc["pos"], mark).otherwise(F.lit(""))).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(order, zero, cut, lambda acc: F.concat(acc["out"], F.substr(text, (acc["pos"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op4_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans, per document."""
    x = pii_spans(docs.select("doc_id", "text"), out="s")
    base = F.filter("s", lambda s: s["kind"].isin(*KINDS))
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return x.select("doc_id", *[count(k) for k in KINDS], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
                    line(F.col("s")).alias("spans"))
