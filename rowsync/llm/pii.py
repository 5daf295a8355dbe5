"""Personal data: fixed patterns, and contextual extraction that starts from what they find.

Fixed patterns give seed entities. Every seed, and every other token shaped like an identifier, is an instance with two
lexical patterns: the word before it and the word after it. Spark scores the graph of patterns and instances in turns, until none adds an instance: a
pattern by the share of its instances that are believed, an instance by its best pattern. Identifiers of patterns that
are believed widely enough are added. Everything is DataFrame functions; after the first pass over the texts only small
tables are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lower_ascii, row_keys, skew_lookup, stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The kinds' patterns in possessive form: a run that can't match is passed over once, so the time is linear.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: with a digit or an at sign.
CANDIDATE = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z._%+()-]*+[0-9@])[A-Za-z0-9@._%+()-]++"
#: Numbers written in groups with single spaces between them: as many whole groups as have 19 digits at most. Possessive
#: between the digits, so a place where one may begin costs a bounded number of steps.
GROUPED = r"(?<![A-Za-z0-9@._%+()-])(?=[0-9()+.-]++\x20[(+]{0,2}+[0-9])[(+]{0,2}+[0-9](?:[()+.-]{0,3}+(?:\x20[(+]{0,2}+)?+[0-9]){7,18}(?![()+.-]*+[A-Za-z0-9@_%])"
MOST_TURNS, SUPPORT, BELIEVED = 40, 3, 0.6
CONTEXT_CHARS = 24


def digits_of(c: Column) -> Column:
    return F.translate(c, "() +.-", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def passes(kind: str, v: Column) -> Column:
    n = F.length(digits_of(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(v))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _running(a: Column, plus=lambda x, y: x + y) -> Column:
    """Running sums of an array<int>, or other totals by ``plus``, in blocks, so that long arrays take less than square time."""
    size = 64
    none = F.lit(None).cast("int")
    total_of = lambda xs: F.aggregate(xs, none, lambda x, y: F.coalesce(plus(x, y), y))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda j: total_of(F.slice(a, j * size + 1, size)))
    before = lambda b: F.transform(b, lambda _, j: total_of(F.slice(b, F.lit(1), j)))

    def total(a: Column, b: Column) -> Column:
        def at(i: Column) -> Column:
            own = total_of(F.slice(a, F.floor(i / size).cast("int") * size + 1, i % size + 1))
            return let(F.get(b, F.floor(i / size).cast("int")), lambda x: F.coalesce(plus(x, own), own))

        return F.transform(a, lambda _, i: at(i))

    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(a, lambda a: let(let(blocks(a), before), lambda b: total(a, b))))


def _greatest(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def _free(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``.

    A span overlaps if among the base spans that begin before its end one ends after its start. Those are found in two
    short searches over the sorted base spans, whose running greatest ends are worked out once.
    """
    sorted_base = F.sort_array(F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))

    def select(b: Column, tops: Column) -> Column:
        root = F.ceil(F.sqrt(F.size(b))).cast("int")
        firsts = F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / root).cast("int")), lambda j: F.get(b, j * root)["s"])
        upto = lambda xs, e: F.size(F.filter(xs, lambda s: s < e))

        def clear(c: Column, heads: Column) -> Column:
            group = F.greatest(upto(heads, c["e"]) - 1, F.lit(0))
            n = let(group, lambda g: g * root + F.size(F.filter(F.slice(b, g * root + 1, root), lambda x: x["s"] < c["e"])))
            return F.coalesce(F.get(tops, n - 1) <= c["s"], F.lit(True))

        return let(firsts, lambda heads: F.filter(more, lambda c: clear(c, heads)))

    found = let(sorted_base, lambda b: let(_running(F.transform(b, lambda x: x["e"]), _greatest), lambda tops: select(b, tops)))
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(found)


def matches(text: Column, pattern: str) -> Column:
    """All matches: array<struct<s, e, v, l, r>> with code point bounds, the text, and the text just before and after."""

    def build(m: Column, p: Column) -> Column:
        gaps = F.transform(m, lambda _, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
        return let(
            _running(gaps),
            lambda at: F.transform(
                m,
                lambda v, i: F.struct(
                    F.get(at, i).alias("s"), (F.get(at, i) + F.length(v)).alias("e"), v.alias("v"),
                    F.substring(F.get(p, i), -CONTEXT_CHARS, CONTEXT_CHARS).alias("l"), F.substring(F.get(p, i + 1), 1, CONTEXT_CHARS).alias("r"),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: build(m, p)))


def _kind_of(v: Column) -> Column:
    """Which kind a candidate is shaped like; null for none."""
    v = F.translate(v, " ", "")
    n = F.length(F.translate(v, "0123456789", "0123456789")) - F.length(F.translate(v, "0123456789", ""))
    only = F.length(F.translate(v, "0123456789()+.-_%", "")) == 0
    return (
        F.when(v.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), 0)
        .when(v.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), 1)
        .when(only & n.between(16, 19), 2)
        .when(only & n.between(8, 15), 3)
    )


def _word(c: Column, pattern: str) -> Column:
    return F.regexp_replace(lower_ascii(F.regexp_extract(c, pattern, 1)), "[0-9]", "9")


_OCC = "array<struct<k:int,s:int,e:int,v:string,l:string,r:string>>"


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, base, more): the fixed patterns' spans and the other candidates of each row."""
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = df.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    none = F.array().cast(_OCC)
    text = F.col("text")

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda x: passes(kind, x["v"]))
        return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r")))

    worth = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{14}"), "phone": text.rlike(r"\+[0-9]")}
    base = F.concat(*[F.when(worth[kind], of(k, kind)).otherwise(none).cast(_OCC) for k, kind in enumerate(KINDS)])
    shaped = lambda pattern: F.filter(
        F.transform(matches(text, pattern), lambda x: F.struct(_kind_of(x["v"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r"))),
        lambda x: x["k"].isNotNull(),
    )
    out = rows.withColumn("base", base).withColumn("more", F.concat(F.when(text.rlike("[0-9]{2}|[0-9][().+_%-]+[0-9]|@"), shaped(CANDIDATE)).otherwise(none).cast(_OCC), F.when(text.rlike(r"[0-9][()+.-]{0,3}\x20[(+]{0,2}[0-9]"), F.filter(shaped(GROUPED), lambda x: F.contains(x["v"], F.lit(" ")))).otherwise(none).cast(_OCC)))
    return out.select("k1", "k2", "id", "base", _free(F.col("more"), F.col("base")).alias("more"))


def _believed(seen: DataFrame) -> DataFrame:
    """Instances (inst, n) of ``seen(inst, seed, pattern)`` that aren't seeds and that the scored graph believes.

    Scores only rise from turn to turn, so turns go on until one believes no more instances than the turn before.
    """
    pairs = stored(seen.groupBy("pattern", "inst").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pairs")
    total = max(1, pairs.count())
    score, before = None, -1
    for _ in range(MOST_TURNS):
        scored = pairs.withColumn("score", F.col("seed")) if score is None else skew_lookup(pairs, score, ["inst"], "links", total, ["score"], F.col("pattern"))
        trust = scored.groupBy("pattern").agg(F.count("*").alias("links"), F.avg("score").alias("mean"), F.count_if(F.col("score") >= BELIEVED).alias("support"))
        trust = trust.select("pattern", "links", F.when(F.col("support") >= SUPPORT, F.col("mean")).otherwise(0.0).alias("trust"))
        told = skew_lookup(pairs, trust, ["pattern"], "links", total, ["trust"], F.col("inst"))
        score = stored(told.groupBy("inst").agg(F.count("*").alias("links"), F.max("seed").alias("seed"), F.max(F.greatest("seed", "trust")).alias("score"), F.sum("n").alias("n")), "scores")
        believed = score.where(F.col("score") >= BELIEVED).count()
        if believed == before:
            return score.where((F.col("seed") == 0) & (F.col("score") >= BELIEVED)).select("inst", "n")
        before = believed
    raise RuntimeError("the patterns' scores did not settle")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, base, spans), one row for each input row.

    ``base`` and ``spans`` are array<struct<k, s, e>> by kind and start; ``spans`` holds all of ``base``. ``k1`` and
    ``k2`` are row_keys of id and text. Null and empty texts have no spans. Repeated rows have equal spans; they count
    once each in the patterns. An empty table gives an empty one.
    """
    docs = stored(found(df, id_col, text_col), "spans")
    occurrence = lambda c, seed: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(x["k"], lower_ascii(F.translate(x["v"], "() +-", ""))).alias("inst"), F.lit(float(seed)).alias("seed"), x["l"].alias("l"), x["r"].alias("r")))
    each = docs.select("k1", "k2", F.explode(F.concat(occurrence(F.col("base"), 1), occurrence(F.col("more"), 0))).alias("x")).select("k1", "k2", "x.*")
    left = F.xxhash64(F.lit("L"), "k", _word(F.col("l"), r"(\S{1,16})\s*$"))
    right = F.xxhash64(F.lit("R"), "k", _word(F.col("r"), r"^\s*(\S{1,16})"))
    new = _believed(each.select("inst", "seed", F.explode(F.array(left, right)).alias("pattern")))
    others = each.where("seed = 0").select("k1", "k2", "k", "s", "e", "inst")
    total = max(1, others.count())
    added = skew_lookup(others, new.withColumn("hit", F.lit(True)), ["inst"], "n", 2 * total, ["hit"], F.struct("k1", "s")).where("__found")
    added = added.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))
    plain = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    out = docs.join(added, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left").withColumn("base", F.sort_array(plain))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return out.select("k1", "k2", "id", "base", spans.alias("spans"))


def as_string(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and ``clean_text``: each span, spans that overlap as one, replaced by its kind in brackets."""
    spans = personal_data(df, id_col, text_col).where(F.size("spans") > 0).select("k1", "k2", F.sort_array(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))).alias("spans"))
    spans = spans.groupBy(F.col("k1").alias("s1"), F.col("k2").alias("s2")).agg(F.first("spans").alias("spans"))
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = df.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    j = rows.join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def apart(a: Column, tops: Column) -> Column:
        """Overlapping spans as one: it begins where no span before it reaches, and ends where the next begins to be so."""
        marked = F.transform(a, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.get(tops, i - 1).alias("p")))
        heads = F.filter(marked, lambda x: x["p"].isNull() | (x["s"] >= x["p"]))
        return let(heads, lambda h: F.transform(h, lambda x, i: F.struct(x["s"].alias("s"), F.coalesce(F.get(h, i + 1)["p"], F.array_max(tops)).alias("e"), x["k"].alias("k"))))

    size = 4096
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))

    def rebuilt(a: Column, blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / size).cast("int")
            some = F.slice(blocks, first + 1, F.floor((end - 1) / size).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(some, ""), start - first * size + 1, end - start)).otherwise("")

        end_of = lambda i: F.coalesce(F.get(a, i)["e"], F.lit(0))
        before = F.transform(a, lambda x, i: F.concat(piece(end_of(i - 1), x["s"]), F.get(tags, x["k"])))
        return F.concat(F.array_join(before, ""), piece(end_of(F.size(a) - 1), F.length("text")))

    merged = let(F.col("spans"), lambda a: let(_running(F.transform(a, lambda x: x["e"]), _greatest), lambda tops: apart(a, tops)))
    clean = let(merged, lambda a: let(parts, lambda blocks: rebuilt(a, blocks)))
    return j.select("row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean).alias("clean_text"))


def _count(spans: Column, k: int) -> Column:
    """How many spans are of kind ``k``. ``k`` is bound here: a lambda's second parameter, default or not, is the place in the array."""
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [_count(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_string(F.col("base")), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
