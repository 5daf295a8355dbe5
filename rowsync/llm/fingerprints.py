"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's tokens are its words (long ones in parts of TOKEN_CHARS code points; Han characters one by one). A window of K
tokens is a syncmer if the least of its inner substrings of S tokens lies at either end of it. That depends on the
window alone, so an edit moves no anchor elsewhere. A fingerprint is the SKETCH least of the syncmers' 32-bit hashes, in
hexadecimal; two fingerprints' likeness estimates the Jaccard similarity of the syncmer sets. ``anchors`` gives all
syncmers with their places, for matching passages by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_or_empty

K, S, TOKEN_CHARS, SKETCH = 5, 2, 24, 128
TOKEN = rf"\p{{IsHan}}|[^\s\p{{IsHan}}]{{1,{TOKEN_CHARS}}}"
#: Range buckets: one for so many rows, but within these limits, so that what the driver holds of them is bounded.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 1 << 10, 1 << 16
#: Ids that the ranges' bounds are taken from, about; which ones their hashes say. All rows are dealt out by the bounds.
BOUND_IDS = 1 << 20


def _low(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def _windows(text: Column, wanted) -> Column:
    """``wanted(h, some)`` of the tokens' hashes and, for each window of K, its hash if it is a closed syncmer, else null."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def select(h: Column) -> Column:
        inner = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))

        def closed(s: Column) -> Column:
            # the K - S + 1 inner substrings of window i are s[i] ... s[i + 3]
            return F.transform(
                F.slice(s, 1, F.size(s) - (K - S)),
                lambda x, i: F.when(F.least(x, F.get(s, i + 3)) <= F.least(F.get(s, i + 1), F.get(s, i + 2)), _low(F.xxhash64(x, F.get(s, i + 2), F.get(s, i + 3)))),
            )

        return wanted(h, let(inner, closed))

    return let(tokens, select)


def anchors(text: Column) -> Column:
    """All closed syncmers of ``text`` in order: array<struct<at, hash>>, ``at`` the place of the first of K tokens.

    They depend on their own tokens alone, so equal passages of two texts have equal hashes at places that differ by the
    same number. Texts under K tokens have none.
    """
    marks = lambda h, some: F.when(F.size(h) >= K, F.filter(F.transform(some, lambda x, i: F.struct(i.alias("at"), x.alias("hash"))), lambda x: x["hash"].isNotNull()))
    return F.coalesce(_windows(text, marks), F.array().cast("array<struct<at:int,hash:bigint>>"))


def syncmers(text: Column) -> Column:
    """Hashes of the closed syncmers of ``text``, 0 to 2**32 - 1, distinct, ascending: array<bigint>.

    A text without any syncmer, as most of fewer than K + 2 tokens are, has one hash, of all its tokens; without tokens
    there is one as well.
    """

    def select(h: Column, some: Column) -> Column:
        whole = F.array(_low(F.xxhash64(h)))
        return F.when(F.size(h) < K, whole).otherwise(let(F.filter(some, lambda x: x.isNotNull()), lambda m: F.when(F.size(m) == 0, whole).otherwise(m)))

    return F.sort_array(F.array_distinct(_windows(text, select)))


def sketch(text: Column) -> Column:
    """The SKETCH least syncmers, ascending: array<bigint>; never empty."""
    return F.slice(syncmers(text), 1, SKETCH)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches: the share of the SKETCH least of their union that both have; 1 for two empty ones."""
    both = let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def _longs(values: list[int | None]) -> Column:
    """A constant array<bigint>, made of one string so that a long one stays a small expression; folded before it runs."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _bucket(bounds: list[int], c: Column) -> Column:
    """The number of ascending ``bounds`` at or below ``c``; 0 for null. Two short searches in place of a long one."""
    if not bounds:
        return F.lit(0)
    root = math.isqrt(len(bounds) - 1) + 1
    at = lambda xs: F.size(F.filter(xs, lambda b: b <= c))
    group = F.greatest(at(_longs(bounds[::root])) - 1, F.lit(0))
    return F.coalesce(group * root + at(F.slice(_longs(bounds), group * root + 1, F.lit(root))), F.lit(0))


def with_next(df: DataFrame, id_col: str, cols: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """Each row's id and ``cols``, and as ``next_<name>`` those of the row with the next id; of the first for the last.

    Null ids come first; rows with equal ids are ordered by the hash of their values and lie in one range, so ids should
    name rows. One shuffle: rows are dealt out by
    ranges of ids, and the first row of each range is also sent to the range before it.
    """
    ids = df.select(F.col(id_col).alias("id"))
    total = ids.count()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, total // BUCKET_ROWS))
    share = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
    some = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, total // BOUND_IDS))) == 0)).distinct()
    found = (some.agg(F.percentile_approx("id", share, 20 * buckets)).first()[0] or []) if buckets > 1 else []
    bounds = sorted(set(found))
    bucket = _bucket(bounds, F.col("id"))
    firsts = {r["b"]: r["first"] for r in ids.groupBy(bucket.alias("b")).agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("first")).collect()}  # one row for each bucket
    used = sorted(firsts)
    if not used:
        used, firsts = [0], {0: 0}
    before = {b: used[k - 1] for k, b in enumerate(used)}
    first = F.get(_longs([firsts.get(b) for b in range(used[-1] + 1)]), F.col("bucket"))
    prev = F.get(_longs([before.get(b) for b in range(used[-1] + 1)]), F.col("bucket")).cast("int")
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in cols.items()]).withColumn("bucket", bucket.cast("int"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))
    ghost = F.struct(prev.alias("b"), F.lit(1).alias("ghost"))
    is_first = F.coalesce("id", F.lit(-(1 << 63))) == first
    dealt = rows.withColumn("to", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))).withColumn("tie", F.xxhash64(*[c for c in cols]))
    w = Window.partitionBy("to.b").orderBy("to.ghost", F.col("id").asc_nulls_first(), "tie")
    out = dealt.select("*", *[F.lead(n).over(w).alias(f"next_{n}") for n in cols])
    return out.where("to.ghost = 0").select("id", *cols, *[f"next_{n}" for n in cols])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and likenesses; one row for each input row.

    The edited text has the last half (rounded down) of the code points replaced by as many first ones of the next
    document's text, or all that there are. Null text counts as empty; empty texts share a fingerprint. Repeated rows
    are neighbours of each other. A single row is its own next. An empty table gives an empty one.
    """
    base = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    cols = {"text": F.col("text"), "marks": sketch(F.col("text"))}
    n = with_next(base, "doc_id", cols).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.when(half > 0, F.substring(F.col("next_text"), F.lit(1), half)).otherwise(""))
    e = n.withColumn("edited", edited).withColumn("edited_marks", sketch(F.col("edited")))
    return e.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("marks")).alias("fingerprint"), as_string(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
