"""Tables between the steps of a job, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table that is no larger is dealt to all cores before heavy expressions; a larger one has tasks enough.
SMALL_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or else the checkpoint folder of the context.

    Only a local session (tests) may lack both: then a temporary folder is made, once. A cluster without a shared folder
    raises, as its executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orderflow-"))
        made = context._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; nothing else uses it."""
    return f"{shared_folder(spark)}/orderflow-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written and read again, for a table that several later steps need: they do not compute it anew, and a
    lost executor takes nothing with it."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    _made.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Folders that ``stored`` made and nobody dropped yet.
_made: list[str] = []


class scratch_kept:
    """``with scratch_kept(spark):`` deletes on leaving what ``stored`` made within, if all results have been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.since = len(_made)

    def __exit__(self, kind, error, trace):
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        while len(_made) > self.since:
            path = jvm.org.apache.hadoop.fs.Path(_made.pop())
            path.getFileSystem(conf).delete(path, True)


def spread(rows: DataFrame) -> DataFrame:
    """A small table dealt to all cores, as few files make few tasks; a larger one as it is."""
    if rows.isStreaming or rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL_BYTES:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
