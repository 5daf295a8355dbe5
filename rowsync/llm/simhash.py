"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Distinct fingerprints are dealt into blocks of one population count each. Two blocks are compared only if their counts
differ by no more than the radius; inside a pair of blocks numpy compares tile by tile with exclusive-or and bit
counts, skipping tile pairs whose population counts, taken for each of four 16-bit lanes, must differ beyond the radius.
A pair of blocks returns a spanning forest of its links, never all pairs, so large groups stay linear in the output.

Fingerprints may have more than one 64-bit word. Tiles then compare the first words, and pairs within the radius must
also be within a second radius over all words. A wide second radius finds texts that share four fifths of their shingles,
which one word can't tell from chance among many texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, row_keys, skew_lookup, stored, table, text_or_empty, without
from .components import components

SEED, TILE = 42, 512
#: Blocks per side while a block stays under MAX_BLOCK fingerprints (8 bytes each).
GRID, MAX_BLOCK = 24, 4_000_000
#: Pairs within the first radius that are looked at over all words at once.
PAIRS = 1 << 14
#: Shingles hashed at once.
SLICE = 1 << 15
#: For near copies, five-word shingles and a similarity of 0.8: words of a fingerprint, differing bits of the first and of
#: all. Sets of shingles with a Jaccard similarity of 0.8 differ in 78 of 512 bits on average, with a deviation of 8.
WIDE = {"shingle": 5, "words": 8, "radius": 14, "total_radius": 84}


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits for each hash, the ``k``-th time; the hash itself for 0."""
    if not k:
        return h
    u = np.uint64
    with np.errstate(over="ignore"):
        x = h + u(k) * u(0x9E3779B97F4A7C15)
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def fingerprint(text: str, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of one text: A-Z lower-cased, words split at ASCII white space, repeats included."""
    return int(wide_fingerprint(text, shingle, 1)[0])


def wide_fingerprint(text: str, shingle: int, n_words: int) -> np.ndarray:
    """``n_words`` signed 64-bit words; the first is ``fingerprint``."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(n_words, np.int64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    bits, hashed = np.zeros(64 * n_words, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE], strict=True)), np.uint64)
        all_words = np.stack([_mixed(h, k) for k in range(n_words)], 1)
        bits += np.unpackbits(all_words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * bits > n, bitorder="little").view(np.int64)


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """``row`` (the input row) and ``words``, its fingerprint as array<bigint>."""

    prepare(df.sparkSession)

    @F.pandas_udf("array<bigint>")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([wide_fingerprint(t, shingle, words) for t in s], dtype=object)

    return df.select(F.struct("*").alias("row"), fp(text_or_empty(text_col)).alias("words"))


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of nodes i[k] and j[k]; ``labels`` maps each node to the least of its group, before and after."""
    while i.size:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def lanes(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _tiles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (n, words) in order of their first words' counts, and the least and greatest counts of each tile."""
    counts = lanes(x[:, 0].copy())
    x, counts = x[order := np.lexsort(counts.T)], counts[order]
    at = np.arange(0, len(x), TILE)
    return x, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def links(a: np.ndarray, b: np.ndarray | None, radius: int, total_radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the pairs within ``radius``: inside ``a`` if ``b`` is None, else across.

    ``a`` and ``b`` are fingerprints (n,) or (n, words); first words name the nodes and must differ. ``total_radius`` also
    bounds the differing bits of all words.
    """
    wide = lambda x: x.reshape(len(x), -1).astype(np.int64).view(np.uint64)
    a, lo_a, hi_a = _tiles(wide(a))
    same = b is None
    b, lo_b, hi_b = (a, lo_a, hi_a) if same else _tiles(wide(b))
    first_a, first_b = a[:, 0].copy(), b[:, 0].copy()
    values = first_a if same else np.concatenate((first_a, first_b))
    order = np.argsort(values.view(np.int64), kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    rank_a, rank_b, labels = rank[: len(a)], rank if same else rank[len(a) :], np.arange(len(values))
    for s in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[s], lo_a[s] - hi_b)).sum(1)
        own = first_a[s * TILE : (s + 1) * TILE, None]
        for t in np.nonzero(gap <= radius)[0]:
            if same and t < s:
                continue
            i, j = np.nonzero(np.bitwise_count(own ^ first_b[None, t * TILE : (t + 1) * TILE]) <= radius)
            i, j = s * TILE + i, t * TILE + j
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                if total_radius is not None:
                    # pairs that are already one group need no second look
                    apart = labels[rank_a[x]] != labels[rank_b[y]]
                    x, y = x[apart], y[apart]
                    near = np.bitwise_count(a[x] ^ b[y]).sum(1) <= total_radius
                    x, y = x[near], y[near]
                merge(labels, rank_a[x], rank_b[y])
    ordered = values.view(np.int64)[order]
    off = np.nonzero(labels != np.arange(len(labels)))[0]
    return ordered[off], ordered[labels[off]]


def near_links(fps: DataFrame, radius: int = 4, total_radius: int | None = None) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fps(fp, words)`` exactly as all pairs within the radii do."""
    spark = fps.sparkSession
    fps = fps.select("fp", "words", F.bit_count("fp").cast("int").alias("p"))
    counts = {r["p"]: r["count"] for r in fps.groupBy("p").count().collect()}  # 65 rows at most
    total = sum(counts.values())
    if not total:
        return spark.createDataFrame([], "u long, v long")
    size = min(MAX_BLOCK, max(1024, math.ceil(total / GRID)))
    parts = [math.ceil(counts.get(p, 0) / size) for p in range(65)]
    first = np.concatenate(([0], np.cumsum(parts))).tolist()
    at = lambda xs, c: F.get(F.array(*map(F.lit, xs)), c)
    blocks = fps.groupBy((at(first, F.col("p")) + F.pmod(F.xxhash64("fp"), at(parts, F.col("p")))).cast("int").alias("block"), "p").agg(F.count("*").alias("n"), F.flatten(F.collect_list("words")).alias("fps"))
    upto = F.least(F.col("p") + radius, F.lit(64)) + 1
    partners = F.sequence(at(first, F.greatest(F.col("p") - radius, F.lit(0))), at(first, upto) - 1)
    dealt = blocks.select("block", "n", "fps", F.explode(partners).alias("other")).select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "n", "fps")
    n = max(1, min(sum(parts) ** 2, 4 * spark.sparkContext.defaultParallelism))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sides = [np.asarray(x, np.int64).reshape(k, -1) for x, k in zip(pdf["fps"], pdf["n"], strict=True)]
        u, v = links(sides[0], sides[1] if len(sides) > 1 else None, radius, total_radius)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.repartition(n, "lo", "hi").groupBy("lo", "hi").applyInPandas(compare, "u long, v long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, words: int = 1, total_radius: int | None = None) -> DataFrame:
    """(id, k1, k2, fp, component_id, root): one row per input row.

    ``component_id`` is the least id reachable over fingerprints within the radii, the row's own included (null ids are
    passed over; a group with null ids only has null); ``root`` names the group, also where it has no id; ``k1`` and
    ``k2`` are row_keys of id and text. Null and empty texts have fingerprint zero and link like any other. Texts with
    equal first words are one node, whose other words are the least of theirs. Repeated rows stay. An empty table gives
    an empty one.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    docs = with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), k1.alias("k1"), k2.alias("k2")), "text", shingle, words)
    docs = stored(docs.select("row.id", "row.k1", "row.k2", F.get("words", F.lit(0)).alias("fp"), "words"), "fingerprints")
    alike = docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), *[F.min("words").alias("words")] * (words > 1))
    fps = stored(alike if words > 1 else alike.withColumn("words", F.array("fp")), "distinct")
    roots = components(near_links(fps, radius, total_radius))
    known = fps.join(roots, fps.fp == roots.u, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    known = stored(known, "roots")
    nodes = known.count()
    group = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = skew_lookup(known, group, ["root"], "members", max(nodes, 1), ["component_id"], F.col("fp")).select("fp", "n", "component_id", "root")
    total = fps.agg(F.sum("n")).first()[0] or 0
    return skew_lookup(docs, named, ["fp"], "n", max(total, 1), ["component_id", "root"], F.struct("id", "k1")).select("id", "k1", "k2", "fp", "component_id", "root")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies (WIDE), all columns as they were.

    It is the row with the least id, null after all others. Rows with equal ids are told apart by their texts; of rows
    with equal ids and texts one stays, any of them. An empty table gives an empty one.
    """
    groups = stored(near_groups(df, id_col, text_col, **WIDE).select("root", "k1", "k2", F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2").alias("place")), "groups")
    best = groups.groupBy("root").agg(F.min("place").alias("best"), F.count("*").alias("n"))
    judged = skew_lookup(groups, best, ["root"], "n", max(1, groups.count()), ["best"], F.col("place"))
    gone = judged.where((F.col("best.k1") != F.col("k1")) | (F.col("best.k2") != F.col("k2")))
    left = without(df, row_keys(F.col(id_col), F.col(text_col)), gone)
    twice = stored(groups.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    if twice.isEmpty():
        return left
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    keyed = left.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    side = twice.withColumn("twice", F.lit(True))
    keyed = keyed.join(side, ["k1", "k2"], "left")
    single = keyed.where("twice IS NULL").select("row.*")
    return single.unionByName(keyed.where("twice").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*"))


def hex64(c):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), hex64("fp").alias("fingerprint"), "component_id")
