"""Three-way merge: our changes rewritten to apply after theirs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import UnsupportedError
from ..plans.numbering import numbered
from ..plans.storage import stored
from .changes import concat, invert, op_rank, others
from .diff import any_of, diff, equal


def key_mapping(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(old_key, new_key) of our inserts that must move.

    With M the greatest key that they inserted, our k inserts on keys of theirs get M + 1 to M + k in our order (``seq``,
    or by key where there is none). Of our other inserts beyond M, ascending, the j-th moves to M + k + j if its key less
    j is below M + k.
    """
    kind = ours.schema[key].dataType
    empty = ours.sparkSession.createDataFrame([], T.StructType([T.StructField(n, kind) for n in ("old_key", "new_key")]))
    their = stored(theirs.where("op = 'insert'").select(F.col(key).alias("t_key")), "their_keys")
    top = their.agg(F.max("t_key")).first()[0]
    if top is None:
        return empty
    mine = ours.where("op = 'insert'").select(F.col(key).alias("old_key"), (F.col("seq") if "seq" in ours.columns else F.lit(0)).alias("seq"))
    taken = F.col("t_key").isNotNull()
    mine = mine.join(their, F.col("old_key") == F.col("t_key"), "left").where(taken | (F.col("old_key") > top)).select("old_key", taken.alias("taken"), F.when(taken, F.col("seq")).alias("seq"))
    # one numbering: first the keys that are taken, then the others
    all_of = numbered(mine, [F.col("taken").desc(), "seq", "old_key"], "i").select("old_key", "taken", "i")
    k = all_of.where("taken").count()
    if not k:
        return empty
    moved = F.col("taken") | (F.col("old_key") - (F.col("i") - k) <= top + k - 1)
    return all_of.where(moved).select("old_key", (F.lit(top) + F.col("i")).cast(kind).alias("new_key"))


class Rebased:
    """Our changes after theirs; the keys of our inserts that moved; cells that both changed, ours having won.

    Each is worked out when it is asked for: conflicts need no numbering.
    """

    def __init__(self, ours: DataFrame, theirs: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()):
        if len(keys) != 1 or not isinstance(ours.schema[keys[0]].dataType, (T.IntegralType,)):
            raise UnsupportedError("rebase needs a primary key of one whole-number column")
        self.ours, self.theirs, self.key, self.cols, self.datetimes = ours, theirs, keys[0], others(ours), datetimes
        t = theirs.where("op <> 'insert'").select(F.col(self.key).alias("__t_key"), F.col("op").alias("__t_op"), *[F.col(f"{p}_{c}").alias(f"__t_{p}_{c}") for c in self.cols for p in ("new", "changed")])
        self._both = ours.where("op <> 'insert'").join(t, F.col(self.key) == F.col("__t_key"), "left")

    def _clash(self, c: str) -> tuple[Column, Column, Column]:
        """(they changed the cell too, both did, both to the same value)."""
        theirs_too = F.coalesce((F.col("__t_op") == "update") & F.col(f"__t_changed_{c}"), F.lit(False))
        both = theirs_too & F.col(f"changed_{c}")
        return theirs_too, both, equal(self.ours.schema[f"new_{c}"].dataType, F.col(f"new_{c}"), F.col(f"__t_new_{c}"), c in self.datetimes)

    @cached_property
    def mapping(self) -> DataFrame:
        return key_mapping(self.ours, self.theirs, self.key)

    @cached_property
    def inserts(self) -> DataFrame:
        ours, key = self.ours, self.key
        moved = ours.where("op = 'insert'").join(self.mapping, F.col(key) == F.col("old_key"), "left")
        return moved.select(*[F.coalesce("new_key", key).alias(key) if c == key else F.col(c) for c in ours.columns])

    @cached_property
    def others(self) -> DataFrame:
        """Our updates and deletes of rows that they didn't delete."""
        update = F.col("op") == "update"
        cells = {}
        for c in self.cols:
            theirs_too, both, agree = self._clash(c)
            old = F.when(theirs_too & ((F.col("op") == "delete") | F.col(f"changed_{c}")), F.col(f"__t_new_{c}")).otherwise(F.col(f"old_{c}"))
            still = F.when(update, F.col(f"changed_{c}") & ~(both & agree)).otherwise(F.col(f"changed_{c}"))
            cells |= {f"old_{c}": F.when(still, old), f"new_{c}": F.when(still, F.col(f"new_{c}")), f"changed_{c}": still}
        kept = self._both.where(F.coalesce(F.col("__t_op") != "delete", F.lit(True)))
        kept = kept.where(~update | any_of([cells[f"changed_{c}"] for c in self.cols]))
        return kept.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in self.ours.columns])

    @cached_property
    def changes(self) -> DataFrame:
        return self.inserts.unionByName(self.others)

    @cached_property
    def conflicts(self) -> DataFrame:
        """(key, column, base, theirs, ours), values as text; ``theirs`` is null where they deleted the row."""
        gone = F.col("__t_op") == "delete"
        cells = []
        for c in self.cols:
            _, both, agree = self._clash(c)
            text = lambda x: F.col(x).cast("string")
            hit = F.when(gone, F.col(f"changed_{c}")).otherwise(both & ~agree)
            cells.append(F.struct(F.lit(c).alias("column"), hit.alias("is"), text(f"old_{c}").alias("base"), F.when(~gone, text(f"__t_new_{c}")).alias("theirs"), text(f"new_{c}").alias("ours")))
        hit = self._both.where((F.col("op") == "update") & F.col("__t_op").isNotNull())
        return hit.select(F.col(self.key), F.explode(F.filter(F.array(*cells), lambda x: x["is"])).alias("x")).select(self.key, "x.column", "x.base", "x.theirs", "x.ours")


def rebase(ours: DataFrame, theirs: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> Rebased:
    """Rewrite ``ours`` (base to ours) so that it applies after ``theirs`` (base to theirs).

    Rows that they deleted lose our changes; updates among these are conflicts. Where both changed a cell differently,
    ours wins and the cell is a conflict. One whole-number key column is needed. Both frames are read several times, so
    they should be stored.
    """
    return Rebased(ours, theirs, keys, datetimes)


def with_seq(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes in the order in which they are written out: inserts, deletes, updates, each by key."""
    return numbered(changes.withColumn("__rank", op_rank()), ["__rank", *keys], "seq").drop("__rank")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(changes from ours to the merge, conflicts): undo ours, do theirs, do ours rebased."""
    return merge(stored(diff(base, ours, keys, datetimes), "ours"), stored(diff(base, theirs, keys, datetimes), "theirs"), keys, datetimes)


def merge(b_o: DataFrame, b_t: DataFrame, keys: list[str], datetimes: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """``three_way`` from the stored changes base to ours and base to theirs."""
    r = rebase(b_o, b_t, keys, datetimes)
    return concat([invert(b_o), b_t, r.changes], keys), r.conflicts
