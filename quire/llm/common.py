"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, in one Arrow batch sent to Python; keeps a batch of long texts well inside a worker's memory.
ARROW_ROWS = 512
ARROW_BYTES = 32 << 20
#: A batch is cut further so that a step in Python sees at most about this many characters (or one text).
STEP_CHARS = 4_000_000
#: The least and most bits of a :class:`Sieve`, and how many it should have for a value.
SIEVE_LEAST, SIEVE_MOST, SIEVE_BITS = 1 << 16, 1 << 27, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as texts can be long: the session's limits are lowered, never raised."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"([0-9]+)[bB]?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's checkpoint folder, or a local one in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


#: Scratch folders that weren't deleted yet, and the session of each.
_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there lives until :func:`forget`, :func:`clean` or the program's end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a table in the shared folder: lost executors don't bring recomputation, and plans end here.

    A checkpoint would keep the size that the optimizer estimated, which grows without bound over rounds of joins; a table
    has the size of its files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def forget(*tables: DataFrame | str | None) -> None:
    """Delete tables of :func:`durable`, or scratch paths, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "quire_path", None)
        spark = _scratch.pop(path, None) if path else None
        if spark is not None and spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_now() -> set[str]:
    """The scratch paths that are there: what a step leaves behind is what it adds to them."""
    return set(_scratch)


@atexit.register
def clean() -> None:
    """Delete all scratch tables of this program: results that were not stored elsewhere go too. Runs at the program's end."""
    for path in list(_scratch):
        try:
            forget(path)
        except Exception:  # noqa: BLE001 - the session may be gone, and the end of the program is no place to fail
            _scratch.pop(path, None)


def spare(taken: Sequence[str], name: str) -> str:
    """A column name that is none of ``taken``, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps from task to task: only what any task could make again.

    It belongs to one operator at a time: another one finds it empty, and what the last one held is freed.
    """
    held = sys.modules.setdefault("_quire_worker_memory", types.ModuleType("_quire_worker_memory")).__dict__
    if held.get("owner") != owner:
        held.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it: freed memory goes back at once
        if trim is not None:
            trim(0)
        held.update(owner=owner, held={})
    return held["held"]


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], how: str, salt_by: Sequence[Column], salts: int = 32) -> DataFrame:
    """Join on keys of which one may hold a third of the rows of ``many``.

    ``few`` has one row a key and is repeated ``salts`` times; a key's rows in ``many`` go to ``salts`` tasks by the hash of
    ``salt_by``. ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.

    What Spark may broadcast is broadcast once and needs no salt. Spark takes a repeated table for as small as the table itself,
    and would broadcast all its copies from the driver, so those are always shuffled.
    """
    if _may_broadcast(few):
        return many.join(F.broadcast(few), list(on), how)
    salt = spare([*many.columns, *few.columns], "salt")
    left = many.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = few.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)]))).hint("merge")
    return left.join(right, [*on, salt], how).drop(salt)


def _may_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size of the table is within the session's limit for broadcasts."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def hot_join(many: DataFrame, few: DataFrame, key: str, n: str, salt_by: Sequence[Column], salts: int = 32, share: int = 1000) -> DataFrame:
    """Inner join on a key where ``few`` knows how many rows of ``many`` each key has, in column ``n``.

    Only keys with more than a ``share``-th of all rows are salted. Fewer than ``share`` keys can have as many, so their list
    is bounded whatever the tables; ``few`` is not repeated for all others.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    hot = [r[0] for r in few.where(F.col(n) > max(total / share, 1000)).select(key).collect()]
    if not hot:
        return many.join(few, key)
    salt = spare([*many.columns, *few.columns], "salt")
    is_hot = F.col(key).isin(hot)
    left = many.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*salt_by), F.lit(salts))).otherwise(0).cast("int"))
    right = few.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt]).drop(salt)


class Sieve:
    """A Bloom filter of 64-bit values: :meth:`may_hold` is true of every value in it, and of few others.

    It is sent to every task; its size is bounded by ``SIEVE_MOST`` bits (16 MB) whatever the number of values, so for more than
    some ten million values it lets more and more of the others pass. Users join exactly what passes, so results don't depend on it.
    """

    def __init__(self, values: DataFrame, column: str, most: int = SIEVE_MOST) -> None:
        bits = SIEVE_LEAST
        n = values.count()
        while bits < min(most, SIEVE_BITS * n):
            bits *= 2
        places = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(bits)) for i in range(4)])).alias("at")
        at = values.select(places)
        words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("set"))
        held = words.toArrow()
        table = np.zeros(bits // 64, np.int64)
        table[held["word"].to_numpy()] = held["set"].to_numpy()
        self.bits = bits
        self.sent = values.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def places(self, value: Column) -> list[Column]:
        """Where the value's bits are, for :func:`sieved`."""
        return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(self.bits)) for i in range(4)]

    def may_hold(self, value: Column) -> Column:
        """Whether the column's value may be in the sieve; JVM-side hashes, one look-up in Python.

        Stages that go through Python anyway take :func:`sieved` there, so that a task needs one worker.
        """
        sent = self.sent

        @F.pandas_udf("boolean")
        def passes(at: pd.DataFrame) -> pd.Series:
            worker_memory("sieve")
            return pd.Series(sieved(sent.value, [at[c].to_numpy() for c in at.columns]))

        return passes(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(self.places(value))]))


def sieved(table: np.ndarray, places: Sequence[np.ndarray]) -> np.ndarray:
    """Of the places of values whether all their bits are set."""
    ok = np.ones(len(places[0]), bool)
    for at in places:
        p = at.astype(np.uint64)
        ok &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def text_steps(texts: Sequence[str | None], most: int = STEP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts with null as empty) of at most ``most`` characters, or one text."""
    step: list[str] = []
    chars, first = 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if step and chars + len(t) > most:
            yield first, step
            step, chars, first = [], 0, i
        step.append(t)
        chars += len(t)
    if step:
        yield first, step


def map_texts(df: DataFrame, text_col: str, keep: Sequence[str], fn: Callable[[list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """Columns ``keep`` of each row beside those that ``fn`` gives for its text, in one Arrow pass.

    ``fn`` takes a list of texts (null as empty) and returns Arrow arrays of that length, in the order of ``schema``, which
    has only the new columns.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("t"))
    out = StructType([f for f in rows.schema.fields if f.name != "t"] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            kept = b.columns[:-1]
            for first, step in text_steps(texts):
                arrays = [k.slice(first, len(step)) for k in kept] + list(fn(step))
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    tuned(df.sparkSession)
    mapped = rows.mapInArrow(run, out)
    return mapped.toDF(*keep, *new.names)
