"""Helpers common to the operators: the shared folder, null-safe text, Arrow mapping."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.sources.shared import fresh_path, shared_dir, written

__all__ = ["Memo", "fresh_path", "give_back", "in_parts", "join_facts", "kept", "map_arrow", "picked_rows", "shared_dir", "small_batches", "whole", "written"]


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


#: Ids up to this number (8 bytes each) are broadcast to pick rows; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


def picked_rows(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` with (``left_anti``: without) a doc_id in ``ids``."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how)


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to ``facts``, which has at most one row per key.

    A key with more rows than an even partition's share would land in one task. There are fewer
    such keys than partitions, so their facts are broadcast and their rows stay where they are;
    all other rows are shuffled. Rows with a null in the key match nothing. ``rows`` is read
    several times and should be a written table.
    """
    share = rows.count() // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = rows.dropna(subset=key).groupBy(*key).count().where(F.col("count") > max(1, share))
    hot = F.broadcast(written(often.select(*key), "hot-keys"))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    return few.unionByName(rows.join(hot, key, "left_anti").join(facts, key, how))


#: Rows of a batch that are moved, and worked, at a time. Texts can be long: of Spark's default of
#: 10,000 in a batch, several copies don't fit beside an executor's heap.
ROWS = 1000


def give_back() -> None:
    """Return freed memory to the system. Python workers live on from stage to stage, and what an
    earlier stage has freed would else count against the executor while a later one runs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # another C library than glibc, which has no such call
        pass


_kept: dict = {}


def kept(key=None, make=None):
    """What ``make`` builds, kept in this Python worker for the tasks that ask for the same key. A
    task with another key, or with none, lets it go, so that a worker holds one thing at a time."""
    if key is None or key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        if key is not None:
            _kept[key] = make()
            give_back()
    return _kept.get(key)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session batches for Python now have at most ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def in_parts(batches):
    """The batches in slices of at most ROWS rows, without empty ones."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def map_arrow(df: DataFrame, fn, schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` where ``fn`` takes one non-empty ``RecordBatch`` and returns or yields some;
    ``keeps``: it uses what ``kept`` holds."""

    def run(batches):
        if not keeps:
            kept()
        try:
            for b in in_parts(batches):
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        finally:
            give_back()

    return small_batches(df).mapInArrow(run, schema)


class Memo:
    """What ``make`` gives for the last keys asked for, between ``size / 2`` and ``size`` of them.

    Two generations: when the younger one is full it becomes the older one, and entries that
    are asked for again move back.
    """

    def __init__(self, make, size: int):
        self.make, self.half = make, size // 2
        self.young: dict = {}
        self.old: dict = {}

    def all(self, keys: list) -> list:
        try:
            return list(map(self.young.__getitem__, keys))
        except KeyError:
            pass
        wanted = set(keys)
        fresh = [k for k in wanted if k not in self.young]
        if len(self.young) + len(fresh) > self.half:
            self.old, self.young = self.young, {}
            fresh = list(wanted)
        old, missing = self.old, []
        for k in fresh:
            got = old.get(k)
            if got is None:
                missing.append(k)
            else:
                self.young[k] = got
        self.young.update(zip(missing, self.make_all(missing), strict=True))
        return list(map(self.young.__getitem__, keys))

    def make_all(self, keys: list) -> list:
        return list(map(self.make, keys))
