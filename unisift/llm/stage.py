"""Results that later steps read more than once are written to the cluster's shared folder.

`written(df, name)` writes Parquet below the folder named in `spark.checkpoint.dir` and reads it back, which
cuts the lineage: files outlive executors. The setting is read from the session; only where it's unset, and the
master is local (as in tests on one machine), a folder beside the warehouse is used.

`discard(*tables)` deletes such tables after their last read. `made()` lists those that are still there, so that a caller
that has stored an operator's result can `delete` what the result was read from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this process has written and not yet discarded, oldest first.
_made: list[str] = []
#: Shuffle files go when the query that made them ends; else they'd stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch, which the executor and its Python worker both hold.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/unisift-checkpoints").rstrip("/")


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """The table, written and read back. Python functions in its plan get batches of about `batch_bytes`, if given, however many rows these are."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/unisift-{name}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._unisift_path = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in list(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _made:
            _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned; nothing may read them any more."""
    for table in tables:
        delete(table.sparkSession, [table._unisift_path])


def made() -> list[str]:
    """Paths of the tables that are still there."""
    return list(_made)
