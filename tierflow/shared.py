"""Tables written to the folder that every executor can read.

Iterative plans cut their lineage here. The folder is the one that the cluster
names in ``spark.checkpoint.dir``; only a session without it (tests) gets a
temporary folder of its own; on a cluster that is an error, since executors could not read it.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
#: Seconds between two requests to collect garbage, and when the last one was.
PAUSE = 2.0
_asked = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tierflow-shared-")
    return _own_folder[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later plans start from the files, so a lost executor costs a re-read and
    never a recomputation of the plan above. The shuffle files behind them are not
    needed any more; Spark removes those as soon as the driver collects its garbage,
    which is asked for here so that they do not pile up over many steps.
    """
    path = f"{shared_folder(df.sparkSession)}/tierflow/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - _asked[0] > PAUSE:
        df.sparkSession._jvm.System.gc()
        _asked[0] = time.monotonic()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored` that no plan needs any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
