"""What the operators of this subpackage share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most so many narrow rows (some tens of bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


#: Bytes of a batch of rows for Python workers, where the session has Spark's default of 64 MB: so a worker's memory
#: doesn't follow the length of the rows.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "3m"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="folium-")) / "folium_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(str(target))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a local session may go without that setting."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []
#: After so many written tables the driver's JVM gives free native memory back, which planning in many threads leaves.
TRIM = 8


def trim(spark: SparkSession) -> None:
    """Has the driver's JVM give free native memory back to the system, where it knows how to."""
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(name, "systemTrimNativeHeap", None, None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, without lineage, and not lost with an executor. The
    folder stays until release()."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    told = Observation()
    df.observe(told, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    _WRITTEN.append((spark, path))
    if len(_WRITTEN) % TRIM == 0:
        trim(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found._folder, found._rows = path, told.get.get("rows")
    return found


def rows_of(df: DataFrame) -> int | None:
    """The number of rows of a written table, which writing it told."""
    return getattr(df, "_rows", None)


def bounded(rows: DataFrame, by: str, order: Column, chars: int) -> DataFrame:
    """Of rows (text, ..), few of each value of `by`: in order, the first and those up to which the texts have at most
    `chars` characters. Texts stay whole."""
    upto = Window.partitionBy(by).orderBy(order, "text")
    df = rows.withColumn("_upto", F.sum(F.length("text").cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(upto))
    return df.filter((F.col("_upto") <= chars) | (F.col("_rank") == 1)).drop("_upto", "_rank")


_KEPT: list[DataFrame] = []
_BROADCAST: list[weakref.ref[Broadcast]] = []


def broadcast(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of value, until release() or until nothing refers to it."""
    made = spark.sparkContext.broadcast(value)
    _BROADCAST.append(weakref.ref(made))
    return made


def kept(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks for more than one use; what a lost executor had is made again from its input. It stays
    until release()."""
    _KEPT.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def _lives(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc is not None


def release(but: DataFrame | None = None) -> None:
    """Gives back what operators hold for results that are lazy: kept tables, broadcasts, and the folders of written tables, but
    for that of `but`. For when the results are written; those that weren't can't be used any more."""
    while _KEPT:
        df = _KEPT.pop()
        if _lives(df.sparkSession):
            df.unpersist()
    while _BROADCAST:
        made = _BROADCAST.pop()()
        if made is not None and made._jbroadcast is not None and made._sc._jsc is not None:
            made.destroy()
    spared = getattr(but, "_folder", None)
    for spark, path in [w for w in _WRITTEN if w[1] != spared]:
        _WRITTEN.remove((spark, path))
        if _lives(spark):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def releasing() -> Iterator[None]:
    """Around calls of operators and the writing of their results; what they held is given back at the end."""
    try:
        yield
    finally:
        release()


def let(name: str, value: str, body: str) -> str:
    """SQL for body, in which name stands for value, computed once even where body's lambdas use it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def small(df: DataFrame, rows: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows; otherwise Spark chooses the join.

    The number is known for a written table, or is at most that of a written table `of` which df is made from; else it is counted.
    """
    known = rows_of(df if of is None else of)
    return F.broadcast(df) if (df.limit(rows + 1).count() if known is None else known) <= rows else df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; when a partition is done, the worker, which stays for others, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def learned(rows: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """fit() of all rows in order, made by one executor. For samples of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(sorted(found)))]})

    made = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
