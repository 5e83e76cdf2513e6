"""What the operators share: tables, durable intermediate results and small helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session in spark.checkpoint.dir, which driver and executors share.

    Where that is unset a temporary folder serves a local master only; on a cluster every
    executor would write to a disk of its own, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="checkpoint-")
        _own_dirs[app] = f"{base.rstrip('/')}/llm-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _own_dirs[app])
    return _own_dirs[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns and text, a null text as the empty one."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


SPREAD_BYTES = 2 << 20  # a core


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where a scan is so small that its row groups may leave most of them idle.

    Larger inputs have row groups enough and stay as they are, so what this moves is bounded by
    SPREAD_BYTES a core, whatever the input's size.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    scanned = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if scanned < cores * SPREAD_BYTES else rows


def column(name: str) -> Column:
    """A top-level column by its exact name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


_one: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any]) -> Any:
    """A worker's one large table: that of key is made when it is first asked for, and drops any other's."""
    if key not in _one:
        _one.clear()
        _one[key] = make()
    return _one[key]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a string array of some size bytes each, with their first rows; a longer text is alone."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to
