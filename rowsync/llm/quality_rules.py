"""Quality rules: text counts, and perplexity bands of a character n-gram model with modified Kneser-Ney smoothing.

N-grams are ORDER bytes (letters lower-cased, digits folded) inside words, between boundary marks. All n-grams of all
words of all documents that the counts pass are counted and smoothed by Spark, so the model is a table that grows with
the corpus; what the counts reject would teach it that such text is usual. Keys that
hold at least one in HEAVY of all n-grams, which are at most HEAVY, are sent to the executors as sorted arrays. A
document's other n-grams are looked up by a join; no such key has more than its small share of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stored, table, text_or_empty
from .words import flat_bytes, gather, slices, words

ORDER = 5
#: Marks the edges of words; no byte of UTF-8.
EDGE = 255
#: The language's number stands above the bits of an n-gram.
LANG_SHIFT = 8 * ORDER
#: At most so many n-grams are sent to the executors: 12 bytes each.
HEAVY = 1 << 20
#: Minus log probabilities are whole multiples of 1 / UNIT, so sums don't depend on their order.
UNIT = 1 << 20
#: A language needs so many documents for a model and bands of its own, whatever the table's size, for a median and a
#: spread mean something only then; the others share those of "*".
OWN_ROWS = 50
#: The bands leave out this share of the good rows that they are set from, half of it on either side.
GOOD_OUTSIDE = 0.01
SYMBOL_SET = b"#*$%&|<>"


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and all digits as one."""
    to = np.arange(256)
    to[ord("0") : ord("9") + 1] = ord("0")
    to[ord("A") : ord("Z") + 1] += 32
    return to.astype(np.int64)[data]


def grams(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the words (ORDER - 1 marks before and one after each), in order, and each word's number of them."""
    data, offsets = flat_bytes(values.cast(pa.large_string()))
    n, lengths = len(offsets) - 1, np.diff(offsets)
    s = np.full(len(data) + ORDER * n, EDGE, np.int64)
    s[np.arange(len(data)) + np.repeat(np.arange(n), lengths) * ORDER + ORDER - 1] = fold(data)
    codes = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for k in range(ORDER):
        codes = codes << 8 | s[k : k + len(codes)]
    starts = offsets[:-1] + ORDER * np.arange(n)
    return codes[gather(starts, lengths + 1)], lengths + 1


class Slice:
    """The n-grams of some documents: words of a language are units, each a run of positions in the distinct keys."""

    def __init__(self, texts: pa.Array, lang: np.ndarray):
        self.n = len(texts)
        self.doc, code, values = words(texts)
        n_word = max(1, len(values))
        units, self.unit = np.unique(lang[self.doc] * n_word + code, return_inverse=True)
        codes, lengths = grams(values)
        starts = np.cumsum(lengths) - lengths
        self.lengths = lengths[units % n_word] if len(values) else np.zeros(0, np.int64)
        self.gram_unit = np.repeat(np.arange(len(units)), self.lengths)
        own = codes[gather(starts[units % n_word], self.lengths)] if len(values) else np.zeros(0, np.int64)
        self.keys, self.at = np.unique((units // n_word)[self.gram_unit] << LANG_SHIFT | own, return_inverse=True)

    def per_doc(self, of_units: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=of_units[self.unit], minlength=self.n).astype(np.int64)

    def counts(self) -> np.ndarray:
        each = np.bincount(self.unit, minlength=len(self.lengths))
        return np.bincount(self.at, weights=each[self.gram_unit], minlength=len(self.keys)).astype(np.int64)

    def cost(self, known: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """For each document the summed costs of its known keys, and its other keys with their numbers."""
        place = np.minimum(np.searchsorted(known, self.keys), max(0, len(known) - 1))
        hit = known[place] == self.keys if len(known) else np.zeros(len(self.keys), bool)
        each = np.where(hit, costs[place], 0) if len(known) else np.zeros(len(self.keys), np.int64)
        total = self.per_doc(np.bincount(self.gram_unit, weights=each[self.at], minlength=len(self.lengths)))
        missed = np.nonzero(~hit[self.at])[0]
        n_missed = np.bincount(self.gram_unit[missed], minlength=len(self.lengths))
        first = np.cumsum(n_missed) - n_missed
        of_token = n_missed[self.unit]
        doc, at = np.repeat(self.doc, of_token), self.at[missed[gather(first[self.unit], of_token)]]
        rest, n = np.unique(doc * max(1, len(self.keys)) + at, return_counts=True)
        ends = np.searchsorted(rest // max(1, len(self.keys)), np.arange(self.n + 1))
        pairs = pa.StructArray.from_arrays([pa.array(self.keys[rest % max(1, len(self.keys))]), pa.array(n.astype(np.int64))], ["key", "n"])
        return total, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)


def _base(texts: pa.Array) -> dict:
    """Numbers of words and of words in repeated windows, and whether they reject a text."""
    n = len(texts)
    doc, code, _ = words(texts)
    covered = np.zeros(len(doc), bool)
    if len(doc) >= 5:
        h = np.zeros(len(doc) - 4, np.uint64)
        for k in range(5):
            h = (h ^ (code[k : len(doc) - 4 + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.nonzero(doc[:-4] == doc[4:])[0]
        h = (h[at] ^ doc[at].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(5):
            covered[at[twice] + k] = True
    out = {"n_words": np.bincount(doc, minlength=n), "n_repeat_words": np.bincount(doc[covered], minlength=n)}
    return out | {"base_failed": (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])}


def _counted(docs: DataFrame, sound: bool = True) -> DataFrame:
    """(key, n) over all words of the documents that the counts pass (all if not ``sound``); summed in each slice of a
    task, then by Spark. Language 0 is all together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                if sound:
                    s = s.filter(pa.array(~_base(s["text"])["base_failed"]))
                g = Slice(s["text"], s["lang"].to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(g.keys), pa.array(g.counts())], ["key", "n"])

    own = docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    own = stored(own, "ngrams")
    return stored(own.withColumn("key", F.col("key").bitwiseAND((1 << LANG_SHIFT) - 1)).groupBy("key").agg(F.sum("n").alias("n")).unionByName(own.where(F.col("key") >= 1 << LANG_SHIFT)), "counted")


def _suffix(order: int) -> Column:
    """The key of the last ``order`` bytes of the n-gram, in its language."""
    keep = (1 << 8 * order) - 1
    return F.shiftleft(F.shiftright("key", LANG_SHIFT), LANG_SHIFT).bitwiseOR(F.col("key").bitwiseAND(keep))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(key, n, cost) of ``counted(key, n)``: minus log probability by interpolated modified Kneser-Ney, in UNITs.

    Lower orders count the different bytes before an n-gram, or occurrences where it begins a word. A context has at most
    256 n-grams and an n-gram is the suffix of at most 256, so no key of these shuffles is large.
    """
    levels = {ORDER: counted.select("key", F.col("n").alias("raw"), F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        starts = F.shiftright("key", 8 * (k - 1)).bitwiseAND(255) == EDGE
        up = levels[k + 1].groupBy(_suffix(k).alias("key")).agg(F.sum("raw").alias("raw"), F.count("*").alias("seen"))
        levels[k] = stored(up.select("key", "raw", (F.when(starts, F.col("raw")).otherwise(F.col("seen")) if k > 1 else F.col("seen")).alias("c")), f"order{k}")
    lower = None
    for k in range(1, ORDER + 1):
        lang = F.shiftright("key", LANG_SHIFT)
        n1, n2, n3, n4 = (F.greatest(F.lit(1.0), F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0))) for i in (1, 2, 3, 4))
        met = levels[k].groupBy(lang.alias("__lang")).agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))  # a row for each language
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [(1 - 2 * y * F.col("n2") / F.col("n1"), 0.95), (2 - 3 * y * F.col("n3") / F.col("n2"), 1.9), (3 - 4 * y * F.col("n4") / F.col("n3"), 2.9)]
        met = met.select("__lang", *[F.greatest(F.lit(0.05), F.least(F.lit(top), v)).alias(f"d{i}") for i, (v, top) in enumerate(d, 1)])
        cut = F.least(F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("c") * 0.95)
        e = levels[k].join(F.broadcast(met), lang == F.col("__lang")).select("key", "raw", "c", cut.alias("cut"))
        context = Window.partitionBy(F.shiftright("key", 8) if k > 1 else lang)
        total = F.sum("c").over(context)
        e = e.select("key", "raw", ((F.col("c") - F.col("cut")) / total).alias("own"), (F.sum("cut").over(context) / total).alias("back"))
        if lower is None:
            e = e.withColumn("below", F.lit(1.0 / 256))
        else:
            e = e.withColumn("__low", _suffix(k - 1)).join(lower, "__low")
        p = F.col("own") + F.col("back") * F.col("below")
        lower = e.select(F.col("key").alias("__low"), p.alias("below"))
        if k == ORDER:
            return e.select("key", F.col("raw").alias("n"), F.round(-F.log(p) * UNIT).cast("long").alias("cost"))
    raise AssertionError


def _measure(s: pa.RecordBatch, known: np.ndarray, costs: np.ndarray) -> dict:
    texts, n = s["text"], len(s)
    data, offsets = flat_bytes(texts)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))

    def total(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of[flags], minlength=n)

    space = (data == 32) | ((data >= 9) & (data <= 13))
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOL_SET)] = True
    out = _base(texts) | {"word_chars": total(((data & 0xC0) != 0x80) & ~space), "n_symbols": total(is_symbol[data])}
    dup = []
    for k in range(n):
        kept = [x for x in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup.append(len(kept) - len(set(kept)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    g = Slice(texts, s["lang"].to_numpy(zero_copy_only=False).astype(np.int64))
    out["n_grams"] = g.per_doc(g.lengths)
    out["cost"], out["other"] = g.cost(known, costs)
    return out


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_grams": "long", "cost": "long", "other": "array<struct<key: long, n: long>>"}


def _broadcast(spark: SparkSession, known: DataFrame):
    """Sorted keys and their costs, sent to the executors."""
    got = known.toArrow()
    keys, costs = (got[c].to_numpy() for c in ("key", "cost"))
    order = np.argsort(keys)
    return spark.sparkContext.broadcast((keys[order], costs[order].astype(np.int32)))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", good: DataFrame | None = None) -> DataFrame:
    """Counts, log perplexity and verdict, a row for each input row.

    ``kept`` is false where the counts fail (``base_failed``) or the log perplexity lies outside the bands of the row's
    language, from ``low`` to ``high``: median less or more so many robust deviations (scaled median of distances), which
    are larger by the root of the ratio where a text has fewer n-grams than the median. How many deviations is set so
    that GOOD_OUTSIDE of the rows with ids in ``good(doc_id)`` lie outside; without any, of all rows that the counts pass.
    Null text has no words; a null or rare language uses the model and bands of all languages together. Repeated rows stay. An empty table gives an
    empty one.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("*")).alias("lang"))
    own = sorted(r["lang"] for r in docs.groupBy("lang").count().where(F.col("count") >= OWN_ROWS).collect() if r["lang"] != "*")  # a row for each language
    numbers = spark.createDataFrame(list(zip(own, range(1, len(own) + 1), strict=True)), "model string, number long")
    docs = docs.join(F.broadcast(numbers), F.col("lang") == F.col("model"), "left").select("doc_id", "text", F.coalesce("number", F.lit(0)).alias("lang"), F.coalesce("model", F.lit("*")).alias("model"))
    model = stored(kneser_ney(_counted(docs.select("text", "lang"))), "model")
    n_all = model.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY >= F.lit(n_all)
    sent = _broadcast(spark, model.where(heavy).select("key", "cost"))  # at most HEAVY rows, whatever the corpus

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for s in slices(b, "text"):
                got = _measure(s, *sent.value)
                rows = pa.array(np.arange(row, row + len(s)))
                row += len(s)
                yield pa.RecordBatch.from_arrays([rows, s["doc_id"], s["model"], *[got[k] if isinstance(got[k], pa.Array) else pa.array(got[k]) for k in FIELDS]], ["row", "doc_id", "model", *FIELDS])

    id_type = df.schema[id_col].dataType.simpleString()
    measured = stored(docs.mapInArrow(measure, f"row long, doc_id {id_type}, model string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())), "measured")
    other = measured.select("row", F.explode("other").alias("o")).select("row", "o.key", "o.n")
    more = other.join(model.where(~heavy).select("key", F.col("cost").alias("each")), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more"))
    measured = measured.drop("other").join(more, "row", "left")
    log_ppl = (F.col("cost") + F.coalesce("more", F.lit(0))) / F.greatest("n_grams", F.lit(1)) / UNIT
    measured = stored(measured.withColumn("log_ppl", log_ppl).drop("row", "cost", "more"), "scored")
    sound = measured.where(~F.col("base_failed"))
    middle = sound.groupBy("model").agg(F.percentile_approx("log_ppl", 0.5, 1000).alias("mid"), F.percentile_approx("n_grams", 0.5, 1000).alias("usual"))
    far = sound.join(F.broadcast(middle), "model").groupBy("model").agg(F.first("mid").alias("mid"), F.first("usual").alias("usual"), F.percentile_approx(F.abs(F.col("log_ppl") - F.col("mid")), 0.5, 1000).alias("mad"))
    far = stored(far, "spreads")  # a row for each model
    deviation = 1.4826 * F.greatest("mad", F.lit(0.004)) * F.sqrt(F.greatest(F.lit(1.0), F.col("usual") / F.greatest("n_grams", F.lit(1))))
    judged = measured.join(F.broadcast(far), "model", "left").withColumn("deviation", deviation)
    z = judged.where(~F.col("base_failed")).select("doc_id", ((F.col("log_ppl") - F.col("mid")) / F.col("deviation")).alias("z"))
    ends = F.percentile_approx("z", [GOOD_OUTSIDE / 2, 1 - GOOD_OUTSIDE / 2], 10_000).alias("ends")
    found = z.join(good.select("doc_id").distinct(), "doc_id", "left_semi").agg(ends).first()["ends"] if good is not None else None
    least, most = found or z.agg(ends).first()["ends"] or (0.0, 0.0)
    judged = judged.withColumn("low", F.col("mid") + least * F.col("deviation")).withColumn("high", F.col("mid") + most * F.col("deviation"))
    inside = ((F.col("log_ppl") - F.col("mid")) / F.col("deviation")).between(least, most)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("mid", "usual", "mad", "deviation")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out)
    return quality_rules(table(spark, sf_dir, "documents"), good=good).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")
