"""Sessions that Python workers can import this package in; the shared folder and the tables cut there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()
#: Rows of an Arrow batch where the session leaves Spark's default: texts can be long, and a batch is in memory whole.
BATCH, BATCH_CONF, BATCH_DEFAULT = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application, and bound what they get at once."""
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = os.path.realpath(os.path.join(tempfile.mkdtemp(), f"{root.name}.zip"))
        with zipfile.ZipFile(to, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(to)
        _shipped.add(context.applicationId)
    return spark


#: Bytes up to which a side may be broadcast; its size is counted first. Executors keep what was broadcast until the
#: driver collects its garbage, so a job of many joins holds many such sides at once.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session, in which there is one machine, gets a folder of its own where it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return f"file://{path}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The plan's lineage ends there, so that a lost executor costs no work from before, and what follows
    several times is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> tuple[int, int]:
    """Rows of a table that cut() wrote, and bytes of their values, counted and not estimated."""
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")), F.lit(0)) for c, f in ((f"`{f.name}`", f) for f in df.schema)), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return rows, size or 0


def fits(side: tuple[int, int]) -> bool:
    """Whether a counted side may be broadcast: values and 64 bytes of a row's own."""
    rows, size = side
    return rows * 64 + size <= BROADCAST_BYTES


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left joined with a table that cut() wrote: broadcast if its counted bytes fit, shuffled beyond."""
    return left.join(F.broadcast(right) if fits(sized(right)) else right.hint("shuffle_merge"), on, how)
