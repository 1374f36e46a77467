"""What the operators of this subpackage share: tables, and the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored table that are sent to all tasks to meet exploded rows.
MOST_SENT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder of the context exists, and all runs on one machine (tests),
    is a temporary folder made, and registered so that it is made once. A cluster without either raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orderflow-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing else uses it."""
    return f"{shared_dir(spark)}/orderflow-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here, and an
    executor that is lost later takes nothing with it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orderflow_path = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete the files of a table that ``written`` made and that nothing reads any more."""
    path = getattr(df, "_orderflow_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def unsent(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that shuffles both sides. Spark takes rows after an explode to be as many as before it, and a file with few
    different values to be as small in memory, so by its own sizes it would broadcast what the driver cannot hold."""
    return rows.hint("merge")


def met_by(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Exploded ``rows`` joined with a stored table, which is sent to all tasks only if its count of rows is small; ``rows`` never are."""
    few = known.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(known) if few else unsent(known), keys)


def text_slices(batch, column: str, most_bytes: int = 4 << 20):
    """Cut an Arrow batch so that each slice holds few bytes of text, or a single row."""
    import pyarrow.compute as pc

    size, at = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0
    while at < len(size):
        end, held = at + 1, size[at]
        while end < len(size) and held + size[end] <= most_bytes:
            held += size[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end
