"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for local sessions that set none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    return _own[app]


class Scratch:
    """Parquet tables of one job. A lost executor costs only the tasks since the last table."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_by(self, df: DataFrame, name: str, key: str, append: bool = False) -> DataFrame:
        """As ``save``, in as many buckets of ``key`` as a shuffle has partitions: joins on it need no shuffle of this side."""
        buckets, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self._table(name)
        df.write.mode("append" if append else "overwrite").format("parquet").option("path", f"{self.root}/{name}").bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return f"{self.root.rsplit('/', 1)[1]}_{name}".replace("-", "_")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
