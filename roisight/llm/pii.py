"""Personal data by fixed expressions and bootstrapped contextual extraction, in built-in functions only.

Base kinds are e-mail addresses, IP addresses, payment cards (Luhn) and phone
numbers.  The expressions are linear: a run of characters is tried once, at its
beginning or where the match before ended, with possessive repeats.

Bootstrapping: base matches are seeds; further instances are all words with a
digit and at least ``LEAST_CODE`` characters.  What has the form of a base kind
but fails its check is an instance that is never marked.  Lexical patterns of an
instance are its one to three left words, its one to three right ones, and one
of each side, with the shape of the value (digits as 0, runs of letters as one)
and, from two words on, also without.  Patterns and distinct values form a bipartite graph.  A
pattern's score p is the mean of its values' scores, where a seed counts one, a
value that accepted patterns have found one less the product of their 1 - p, and
any other nothing.  Patterns with a score of ``LEAST_SCORE`` and values worth
``LEAST_SEEDS`` are accepted; their values count in the next round, until no
round accepts more.  What accepted patterns hold are spans of kind ``context``.

Spans are in code points, end exclusive, ordered by start, then kind as listed.
Patterns and values are 64-bit hashes.  All accepted patterns stay a table,
however many: it is joined to the distinct sets of patterns that rows hold, and
these to the rows, broadcast only under ``BROADCAST_BYTES``.

Defined cases: a null or empty text has no spans; an empty table gives no rows;
repeated rows give a row each and their values count once; a null id is kept; of
equal starts the earlier kind comes first; a text of any length is searched
whole, in time that grows with its length and the root of its matches' number;
other columns are not read, whatever their names, but for those in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roisight.llm._store import checkpointed, maybe_broadcast, small_enough

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CODE = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
#: Fewest characters of a word with a digit that may be an identifier.
LEAST_CODE = 5
#: Words on each side that make patterns.
CONTEXT_WORDS = 3
LEAST_SCORE, LEAST_SEEDS = 0.8, 4
#: Most bytes of patterns in a broadcast, and those that one takes.
BROADCAST_BYTES, PATTERN_BYTES = 48 << 20, 16

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_MATCHES = "array<struct<start:bigint,kind:int,end:bigint,match:string>>"
_INSTANCES = "array<struct<start:bigint,end:bigint,kind:int,value:bigint,patterns:array<bigint>>>"


def bound(f: Callable[[Column], Column], **parts: Column) -> Column:
    """``f`` of a struct of these columns, each computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in parts.items()))), f), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array cut into as many blocks as a block has elements, about."""

    def made(x: Column) -> Column:
        held, size = x["held"], F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x["held"])))).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), ((F.size(held) - 1) / size).cast("int")), lambda b: F.slice(held, b * size + 1, size))
        return F.when(F.size(held) > 0, cuts).otherwise(F.slice(F.array(held), 1, 0))

    return bound(made, held=values)


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, 0 and all numbers before it under an associative operation.

    An array that grows by one is copied each time, so blocks are scanned for themselves.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def inner(block: Column) -> Column:
        return F.aggregate(block, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    before = lambda blocks: inner(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), op)))
    return bound(lambda x: F.flatten(F.zip_with(x["blocks"], before(x["blocks"]), lambda block, at: F.transform(inner(block), lambda y: op(at, y)))), blocks=_blocks(values))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _farther(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _matched(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of all matches (found), the texts before and after them (gaps), and where each begins (starts)."""

    def placed(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint"))
        starts = F.zip_with(scan(steps, _plus), F.slice(gaps, 1, F.size(found)), lambda at, g: at + F.char_length(g))
        return bound(f, found=found, gaps=gaps, starts=starts)

    return bound(placed, found=F.regexp_extract_all(text, F.lit(pattern), 0), gaps=F.split(text, pattern, -1))


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (start, kind, end, match): texts between matches give the positions."""
    row = lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.char_length(m)).alias("end"), m.alias("match"))
    return _matched(text, pattern, lambda x: F.zip_with(x["starts"], x["found"], row))


def _octet(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.char_length(bare) <= 3) & (F.when(F.char_length(bare).between(1, 3), bare).otherwise("0").cast("int") <= 255)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", F.when(F.char_length(digits) <= 19, digits).otherwise("1"))


def base_matches(text: Column) -> tuple[Column, Column]:
    """Seeds, unordered, and what has their form but fails a check; a cheap test spares most texts the expressions."""
    none, digit = F.array().cast(_MATCHES), text.rlike("[0-9]")
    kinds = (
        (F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)),
        (digit & text.rlike(r"[0-9]\.[0-9]"), IP, lambda m: F.forall(F.split(m, r"\."), _octet)),
        (digit, CARD, _luhn),
        (digit & F.contains(text, F.lit("+")), PHONE, lambda m: F.char_length(_digits(m)).between(10, 15)),
    )
    found = [F.when(test, F.transform(located(text, pattern, k), lambda s: F.struct(s.alias("s"), keep(s["match"]).alias("ok")))).otherwise(F.array().cast(f"array<struct<s:{_MATCHES[6:-1]},ok:boolean>>")) for k, (test, pattern, keep) in enumerate(kinds)]  # noqa: B023
    every = F.concat(*found)
    refused = F.filter(every, lambda x: ~x["ok"] & (F.char_length(_digits(x["s"]["match"])) >= 10))
    plain = lambda some: F.coalesce(F.transform(some, lambda x: x["s"]), none)
    return plain(F.filter(every, lambda x: x["ok"])), plain(refused)


def joined_spans(spans: Column) -> Column:
    """Sorted spans (start, kind, end) as disjoint ones (start, end, kind) with the first one's kind."""

    def made(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        rows = F.zip_with(x["spans"], scan(ends, _farther), lambda s, far: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), far.alias("far")))
        return bound(closed, heads=F.filter(rows, lambda h: (h["far"] == 0) | (h["start"] >= h["far"])), last=F.array_max(ends))

    def closed(x: Column) -> Column:
        ends = F.concat(F.transform(F.slice(x["heads"], 2, F.greatest(F.size(x["heads"]), F.lit(1))), lambda h: h["far"]), F.array(x["last"]))
        return F.zip_with(x["heads"], F.slice(ends, 1, F.size(x["heads"])), lambda h, e: F.struct(h["start"].alias("start"), e.alias("end"), h["kind"].alias("kind")))

    return bound(made, spans=spans)


def cut(text: Column, bounds: Column) -> Column:
    """The pieces between sorted positions, one more than these.

    A substring walks from the beginning of its text, so the text is first cut at
    the ends of blocks of positions.
    """
    part = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))
    zero = F.array(F.lit(0).cast("bigint"))

    def made(x: Column) -> Column:
        begins = F.concat(zero, F.transform(x["blocks"], lambda b: F.element_at(b, -1)))

        def pieces(block: Column, begin: Column) -> Column:
            froms = F.concat(F.array(begin), F.slice(block, 1, F.size(block) - 1))
            return bound(lambda y: F.zip_with(froms, block, lambda a, b: part(y["own"], a - begin, b - a)), own=part(text, begin, F.element_at(block, -1) - begin))

        head = F.flatten(F.zip_with(x["blocks"], F.slice(begins, 1, F.size(x["blocks"])), pieces))
        return F.concat(head, F.array(F.substring(text, (F.element_at(begins, -1) + 1).cast("int"), F.lit(2147483647))))

    return bound(made, blocks=_blocks(bounds))


def _near(words: Column) -> Column:
    """The first words of a split text, lower-cased, digits as 0."""
    return F.transform(F.slice(F.filter(words, lambda w: w != ""), 1, CONTEXT_WORDS), lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0"))


def _left(text: Column) -> Column:
    return _near(F.transform(F.slice(F.split(F.reverse(text), r"\s+", CONTEXT_WORDS + 2), 1, CONTEXT_WORDS + 1), F.reverse))


def _right(text: Column) -> Column:
    return _near(F.slice(F.split(text, r"\s+", CONTEXT_WORDS + 2), 1, CONTEXT_WORDS + 1))


def _patterns(value: Column, before: Column, after: Column) -> Column:
    """Hashes of all patterns of a value between two texts."""

    def made(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        firsts = lambda words, name: F.transform(F.filter(F.sequence(F.lit(1), F.lit(CONTEXT_WORDS)), lambda k: k <= F.size(words)), lambda k: F.concat(F.lit(name), F.array_join(F.slice(words, 1, k), " ")))
        both = F.when((F.size(left) > 0) & (F.size(right) > 0), F.array(F.concat_ws(" ", F.lit("B"), F.get(left, F.lit(0)), F.get(right, F.lit(0))))).otherwise(F.array().cast("array<string>"))
        lexical = F.concat(firsts(left, "L "), firsts(right, "R "), both)
        alone = F.filter(lexical, lambda p: F.size(F.split(p, " ")) > 2)
        return F.concat(F.transform(alone, lambda p: F.xxhash64(p)), F.transform(lexical, lambda p: F.xxhash64(p, sides["shape"])))

    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]", "0")
    return F.flatten(F.transform(F.array(F.struct(_left(before).alias("left"), _right(after).alias("right"), shape.alias("shape"))), made))


def _instance(start: Column, value: Column, kind: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), kind.cast("int").alias("kind"), F.xxhash64(value).alias("value"), _patterns(value, before, after).alias("patterns"))


def _codes(piece: Column, start: Column) -> Column:
    """Words with a digit within a text that begins at ``start``, as instances."""

    def made(x: Column) -> Column:
        rows = F.transform(x["found"], lambda m, k: F.struct(m.alias("m"), k.alias("k")))
        long = F.filter(rows, lambda r: F.char_length(r["m"]) >= LEAST_CODE)
        return F.transform(long, lambda r: _instance(start + F.get(x["starts"], r["k"]), r["m"], F.lit(4), F.get(x["gaps"], r["k"]), F.get(x["gaps"], r["k"] + 1)))

    return F.when(piece.rlike("[0-9]"), _matched(piece, CODE, made)).otherwise(F.array().cast(_INSTANCES))


def extract(documents: DataFrame, *, id_col="doc_id", text_col="text", keep: list[str] = ()) -> DataFrame:
    """One row per document: base matches, and all instances with their patterns; ``keep`` names input columns to carry.

    Instances are of a base kind, 4 for words with a digit, -1 for what failed a check.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))
    good, refused = base_matches(F.col("text"))
    formed = docs.withColumn("found", F.struct(good.alias("good"), refused.alias("refused"))).withColumn("base", F.col("found.good"))
    marked = F.sort_array(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform("found.refused", lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), s["end"].alias("end")))))
    spread = formed.withColumn("apart", joined_spans(marked))
    bounds = F.flatten(F.transform("apart", lambda s: F.array(s["start"], s["end"])))
    numbered = F.col("text").rlike("[0-9]") | (F.size("base") > 0)
    pieces = spread.withColumn("pieces", F.when(numbered, cut(F.col("text"), bounds)).otherwise(F.array().cast("array<string>")))
    spans = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # pieces alternate: text, value, text, ..., text
    at = lambda k: F.get("pieces", k)
    values = F.transform("apart", lambda s, k: _instance(s["start"], at(2 * k + 1), s["kind"], at(2 * k), at(2 * k + 2)))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("apart", lambda s: s["end"]))
    codes = F.flatten(F.transform(begins, lambda b, k: _codes(at(2 * k), b)))
    none = F.array().cast(_INSTANCES)
    instances = F.when(F.size("pieces") > 0, F.concat(F.coalesce(values, none), F.coalesce(codes, none))).otherwise(none)
    return pieces.select("doc_id", spans.cast(_SPANS).alias("base"), instances.cast(_INSTANCES).alias("instances"), *(F.col(f"_{c}").alias(c) for c in keep))


def pattern_table(extracted: DataFrame) -> DataFrame:
    """The accepted patterns (pattern, p), by rounds over the graph of patterns and values."""
    flat = extracted.select(F.explode("instances").alias("i")).select(F.explode("i.patterns").alias("pattern"), "i.value", F.col("i.kind").between(0, 3).cast("int").alias("seed"), (F.col("i.kind") >= 0).cast("int").alias("free"))
    edges = flat.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("free").alias("free"))

    def accepted(scored: DataFrame) -> DataFrame:
        one = scored.groupBy("pattern").agg(F.sum("score").alias("worth"), F.avg("score").alias("p"))
        return checkpointed(one.where((F.col("p") >= LEAST_SCORE) & (F.col("worth") >= LEAST_SEEDS)).select("pattern", "p"))

    best = accepted(edges.withColumn("score", F.col("seed").cast("double")))
    count = best.count()
    if not count:
        return best
    # a pattern needs so many values, seeds or found ones, in any round
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern")
    edges = checkpointed(edges.join(enough, "pattern", "left_semi"))
    while True:
        told = edges.where("free = 1").join(maybe_broadcast(best, PATTERN_BYTES), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("told"))
        score = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce(F.when(F.col("free") == 1, F.col("told")), F.lit(0.0)))
        more = accepted(edges.join(told, "value", "left").withColumn("score", score))
        best = checkpointed(best.unionByName(more).groupBy("pattern").agg(F.max("p").alias("p")))
        before, count = count, best.count()
        if count == before:
            return best


def _pattern_sets(extracted: DataFrame) -> tuple[Column, Column]:
    """The distinct patterns of a row's codes, and a key of them; rows without any get a key that spreads."""
    held = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("instances", lambda i: i["kind"] == 4), lambda i: i["patterns"]))))
    return held, F.when(F.size(held) > 0, F.xxhash64(held)).otherwise(F.xxhash64("doc_id", F.lit("none")))


def with_spans(extracted: DataFrame, patterns: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``spans``: base ones and what accepted patterns mark, as (kind, start, end) in order.

    ``stored`` is an extraction of the same texts that is cheap to read once more.
    Keys that collide only join their good patterns, which changes no mark.
    """
    source = extracted if stored is None else stored
    held, key = _pattern_sets(source)
    pairs = source.select(key.alias("_key"), F.explode(held).alias("pattern"))
    pairs = checkpointed(pairs.join(maybe_broadcast(patterns.select("pattern"), PATTERN_BYTES, BROADCAST_BYTES), "pattern", "left_semi").distinct())
    good = pairs.groupBy("_key").agg(F.collect_list("pattern").alias("_good"))
    good = F.broadcast(good) if small_enough(pairs, PATTERN_BYTES, BROADCAST_BYTES) else good.hint("merge")
    extracted = extracted.withColumn("_key", _pattern_sets(extracted)[1]).join(good, "_key", "left").drop("_key")
    marked = F.when(F.col("_good").isNotNull(), F.filter("instances", lambda i: (i["kind"] == 4) & F.arrays_overlap(i["patterns"], F.col("_good")))).otherwise(F.slice("instances", 1, 0))
    more = F.transform(marked, lambda i: F.struct(i["start"].alias("start"), i["kind"].alias("kind"), i["end"].alias("end"))).cast(_SPANS)
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.sort_array(F.concat("base", more))
    named = F.transform(ordered, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return extracted.withColumn("spans", named).drop("base", "instances", "_good")


def find_pii(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document with all spans."""
    extracted = checkpointed(extract(documents, id_col=id_col, text_col=text_col))
    return with_spans(extracted, checkpointed(pattern_table(extracted)))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by the first one's kind in brackets."""

    def made(x: Column) -> Column:
        pieces = cut(text, F.flatten(F.transform(x["apart"], lambda s: F.array(s["start"], s["end"]))))
        kind = lambda k: F.get(x["apart"], F.floor(k / 2).cast("int"))["kind"]
        return F.array_join(F.transform(pieces, lambda piece, k: F.when(k % 2 == 0, piece).otherwise(F.concat(F.lit("["), F.upper(kind(k)), F.lit("]")))), "")

    return F.when(F.size(spans) == 0, text).otherwise(bound(made, apart=joined_spans(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))))
