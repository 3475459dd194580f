"""Helpers shared by the training-data operators: durable cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast, and bytes of what varies in length; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would be wrong, so it raises there.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = getattr(sc, "_lamina_dir", None)
    if not found:
        found = sc._lamina_dir = "file://" + tempfile.mkdtemp(prefix="lamina-")
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` once later cuts hold everything made from it."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._lamina_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession, forget: Callable[[], None]) -> None:
    """Give the system what executors' heaps and Python workers still hold of earlier steps: neither shrinks by itself while work goes on.

    A task for each core collects its executor's garbage and calls ``forget`` in its worker.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            forget()
            yield batch

    n = spark.sparkContext.defaultParallelism
    swept = spark.range(0, n, 1, n).mapInArrow(run, "id long").selectExpr("id", "java_method('java.lang.System', 'gc') AS done")
    swept.write.format("noop").mode("overwrite").save()


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Broadcast hint for ``df`` if it has at most ``rows`` rows and BROADCAST_BYTES by ``size``, bytes of a row that varies in length; else ``df`` as it is. Call it on a ``cut``: it counts."""
    n, total = df.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= BROADCAST_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Non-empty words of ``text``, cut at runs of ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
