"""Language identification by Bayesian fusion of evidence.

Text likelihood: a byte-bigram model of each language, counted over all documents that declare one. Other evidence,
where the table has it: the declared markup language, the address suffix, and the host, whose prior is smoothed from
suffix to registered domain to host. How far each kind of evidence can be trusted is counted, by grouped aggregation,
against the posterior by text alone. An "und" class takes text that fits no language: either the bytes' frequencies over
all languages, without any regard to neighbours, or even 7-bit characters explain it better than every language does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENDABLE, prepare, row_keys, skew_lookup, stored, table, text_or_empty, without
from .words import flat_bytes, slices

#: Languages whose tables are sent to the executors at once, 256 kB each; more are scored in further passes.
TABLES = 64
#: Bigrams that a text's evidence is worth at most; neighbouring bigrams aren't independent.
WORTH = 200
#: Log probability of a byte among even 7-bit characters, and the prior of "und".
UND_BYTE, UND_PRIOR = math.log(1 / 128), 0.01
#: Pseudo-rows that a prior is worth to the level below, and counts added to each cell of the evidence tables.
STRENGTH, ADDED = 20.0, 1.0
UND = "und"


def declared_language(html: Column) -> Column:
    """The primary language that a page's markup declares, lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1)), F.lit(""))


def address_suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, offsets = flat_bytes(texts)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    low = np.arange(256)
    low[65:91] += 32
    b = low[data].astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
    inside = doc[1:] == doc[:-1]
    return (b[:-1] * 256 + b[1:])[inside], doc[:-1][inside], n


def _count(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                langs = s["lang"].dictionary_encode()
                lang_of = langs.indices.to_numpy(zero_copy_only=False)
                codes, doc, _ = _codes(s["text"])
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(codes[lang_of[doc] == k], minlength=1)
                    has = np.nonzero(n)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has, pa.int64()), pa.array(n[has], pa.int64())], ["lang", "code", "n"])

    return docs.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def bigram_table(counts: np.ndarray) -> np.ndarray:
    """Log P(second byte | first) from 65536 counts, smoothed with the bytes' own frequencies."""
    c = counts.reshape(256, 256).astype(float)
    byte = (c.sum(0) + 0.1) / (c.sum() + 25.6)
    return np.log((c + 16 * byte) / (c.sum(1, keepdims=True) + 16)).ravel()


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _totals(df: DataFrame, keys: list[str], vector: str, n: Column) -> DataFrame:
    """(keys, n, c): the sums of ``n`` and, place by place, of the arrays ``vector``; null arrays don't count."""
    cells = df.select(*keys, n.alias("n"), F.posexplode(vector).alias("k", "p")).groupBy(*keys, "k").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return cells.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("c"))


def _doubles(values: list[float]) -> Column:
    """A constant array<double>, made of one string so that a long one stays a small expression."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, train: Column | None = None) -> DataFrame:
    """(id, language, posterior, kept, k1, k2), one row for each input row.

    ``k1`` and ``k2`` are row_keys of the id and all that the answer rests on: text, declared language, host, suffix.

    Each language that a row is counted for is a class, however few rows it has; "und" and "" say nothing. The cost grows
    with the number of languages.

    ``train`` says which language a row's text is counted for (``declared`` if not given). A row is kept if "und" isn't
    the likeliest class. Null or empty text rests on the other evidence alone; with none it is "und". Missing evidence
    says nothing. Ties go to the language first in the alphabet. Repeated rows stay. An empty table gives an empty one.
    """
    prepare(df.sparkSession)
    spark, none = df.sparkSession, F.lit(None).cast("string")
    declared, train = none if declared is None else F.lower(declared), F.lower(declared if train is None else train)
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), declared.alias("declared"), (none if host is None else F.lower(host)).alias("host"), (none if suffix is None else F.lower(suffix)).alias("suffix"), train.alias("train"))
    k1, k2 = row_keys(F.col("id"), F.col("text"), F.col("declared"), F.col("host"), F.col("suffix"))
    docs = docs.withColumns({"k1": k1, "k2": k2})
    total = docs.count()
    named = F.col("train").isNotNull() & ~F.col("train").isin("", UND)
    langs = sorted(r["train"] for r in docs.where(named).select("train").distinct().collect())  # one row for each language
    counted = stored(_count(docs.where(named).select("text", F.col("train").alias("lang"))), "bigrams")
    classes = [*langs, UND]

    def scorer(sent, last: bool):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for b in batches:
                for s in slices(b, "text"):
                    codes, doc, n = _codes(s["text"])
                    size = np.bincount(doc, minlength=n)
                    sums = [np.bincount(doc, weights=row[codes], minlength=n) for row in t]
                    if last:
                        sums[-1] = np.logaddexp(sums[-1], size * UND_BYTE)
                    sums = np.array(sums).reshape(-1, n).T
                    sums = sums * np.minimum(1, WORTH / np.maximum(1, size))[:, None]
                    sums = np.hstack([s["ll"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1), sums])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                    text = pa.nulls(n, pa.string()) if last else s["text"]
                    yield pa.RecordBatch.from_arrays([*[s[c] for c in kept], text, lists, pa.array(size, pa.int64())], [*kept, "text", "ll", "n"])

        return score

    id_type = df.schema[id_col].dataType.simpleString()
    kept = ["id", "k1", "k2", "declared", "host", "suffix"]
    schema = f"id {id_type}, k1 long, k2 long, declared string, host string, suffix string, text string, ll array<double>, n long"
    rows = docs.select(*kept, "text", F.array().cast("array<double>").alias("ll"))
    bytes_of = np.full(256, 0.1)
    for r in counted.groupBy(F.col("code").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).collect():  # 256 rows at most
        bytes_of[r["byte"]] += r["n"]
    no_language = np.tile(np.log(bytes_of / bytes_of.sum()), 256)
    for at in range(0, max(1, len(langs)), TABLES):
        part, last = langs[at : at + TABLES], at + TABLES >= len(langs)
        tables = np.zeros((len(part), 65536))
        if part:
            got = counted.where(F.col("lang").isin(part)).select((F.array_position(F.array(*map(F.lit, part)), F.col("lang")) - 1).cast("int").alias("at"), F.col("code").cast("int").alias("code"), "n").toArrow()  # TABLES * 65536 rows at most
            tables[got["at"].to_numpy(), got["code"].to_numpy()] = got["n"].to_numpy()
        sent = spark.sparkContext.broadcast(np.array([bigram_table(t) for t in tables] + [no_language] * last, np.float32).reshape(-1, 65536))
        rows = stored(rows.drop("n").mapInArrow(scorer(sent, last), schema), "likelihoods")
        sent.unpersist()
    rows = rows.drop("text")
    even = F.concat(F.array_repeat(F.lit(math.log((1 - UND_PRIOR) / max(1, len(langs)))), len(langs)), F.array(F.lit(math.log(UND_PRIOR))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rows = rows.withColumn("post", _softmax(add(F.col("ll"), even))).withColumn("score", F.col("ll"))
    all_of = _totals(rows, [], "post", F.lit(1)).first()["c"] or [0.0] * len(classes)
    base = [x + 1.0 for x in all_of]
    base = [x / sum(base) for x in base]

    def keyed(name: str) -> list[Column]:
        return [F.xxhash64(name).alias("v1"), F.xxhash64(F.lit(7), name).alias("v2")]

    def lookup(rows: DataFrame, name: str, found: DataFrame, column: str) -> DataFrame:
        """``found(v1, v2, n_rows, column)`` for the values of ``name``: sent if it is small."""
        v1, v2 = keyed(name)
        left = rows.withColumn("v1", v1).withColumn("v2", v2)
        if found.count() * len(classes) <= SENDABLE:
            out = left.join(F.broadcast(found.drop("n_rows")), ["v1", "v2"], "left")
        else:
            out = skew_lookup(left, found, ["v1", "v2"], "n_rows", max(1, total), [column], F.struct("id", "n", "k1")).drop("__found")
        return out.drop("v1", "v2")

    for name, given in (("declared", declared), ("suffix", suffix)):
        if given is None or not total:
            continue
        seen = stored(_totals(rows.where(F.col(name).isNotNull()), [name], "post", F.lit(1)), name)
        n_values = seen.count()
        if n_values:
            # log P(value | class), up to a constant
            of = _doubles([c + ADDED * n_values for c in _totals(seen, [], "c", F.col("n")).first()["c"]])
            told = F.zip_with("c", of, lambda c, all_: F.log((c + ADDED) / all_))
            rows = lookup(rows, name, stored(seen.select(*keyed(name), F.col("n").alias("n_rows"), told.alias("told")), name), "told")
            rows = rows.withColumn("score", F.coalesce(add(F.col("score"), F.col("told")), "score")).drop("told")
    prior = _doubles([math.log(x) for x in base])
    if host is not None and total:
        hosts = stored(_totals(rows.where(F.col("host").isNotNull()), ["host"], "post", F.lit(1)), "hosts")
        levels = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("top", F.substring_index("host", ".", -1))
        smooth = lambda c, n, above: F.zip_with(c, above, lambda x, y: (x + STRENGTH * y) / (F.col(n) + STRENGTH))
        top = _totals(levels, ["top"], "c", F.col("n")).select("top", smooth("c", "n", _doubles(base)).alias("of_top"))
        dom = _totals(levels, ["top", "domain"], "c", F.col("n")).join(top, "top").select("domain", smooth("c", "n", "of_top").alias("of_domain"))
        own = levels.join(dom, "domain").select(*keyed("host"), F.col("n").alias("n_rows"), F.transform(smooth("c", "n", "of_domain"), lambda x: F.log(x)).alias("prior"))
        rows = lookup(rows, "host", stored(own, "priors"), "prior")
        prior = F.coalesce("prior", prior)
    out = rows.withColumn("final", _softmax(add(F.col("score"), prior)))
    nothing = (F.col("n") == 0) & F.col("declared").isNull() & F.col("host").isNull() & F.col("suffix").isNull()
    best = F.array_position(F.col("final"), F.array_max("final")).cast("int") - 1
    language = F.when(nothing, UND).otherwise(F.get(F.array(*map(F.lit, classes)), best))
    return out.select("id", language.alias("language"), F.array_max("final").alias("posterior"), (language != UND).alias("kept"), "k1", "k2")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents declare ``lang``; their ``source`` is the host."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages: language by markup, address suffix and host of the url, text without tags."""
    from .url_filter import split_url

    host, _ = split_url(F.col("url"))
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    plain = pages.select("page_id", text.alias("text"), declared_language(F.col("html")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return identify(plain, "page_id", declared=F.col("declared"), host=F.col("host"), suffix=address_suffix(F.col("host")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language could be told, all columns as they were.

    A row goes by its own answer, also where its id is null or another row has it too.
    """
    keys = row_keys(F.col("doc_id"), text_or_empty("text"), F.lower("lang"), F.lower("source"), F.lit(None).cast("string"))
    return without(docs, keys, identify_documents(docs).where(~F.col("kept")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, by text, declared language and source, and pages, by text, markup, address suffix and host."""
    out = {}
    for kind, found in (("document", identify_documents(table(spark, sf_dir, "documents"))), ("page", identify_pages(table(spark, sf_dir, "pages")))):
        ids = [(F.col("id") if kind == k else F.lit(None)).cast("long").alias(name) for k, name in (("document", "doc_id"), ("page", "page_id"))]
        out[kind] = found.select(*ids, "language", F.round("posterior", 6).alias("posterior"), "kept")
    return out["document"].unionByName(out["page"])
