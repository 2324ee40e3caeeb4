"""The shared folder: where lineage is cut and intermediate tables are written.

On a cluster the folder is whatever `spark.checkpoint.dir` names.  Only a local session without the
setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="threadloom-")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write an intermediate as parquet in the shared folder and read it back.

    Used where several plans read one costly result; `schema` may name a user type the columns carry.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    reader = df.sparkSession.read
    return (reader.schema(schema) if schema is not None else reader.schema(df.schema)).parquet(path)
