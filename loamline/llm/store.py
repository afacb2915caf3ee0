"""Written tables in the folder that all executors share.

Every stage that is read more than once, or that ends a long lineage, is
written as Parquet below ``spark.checkpoint.dir`` and read back, so that losing
an executor costs one stage at most.  What no later stage reads is freed; the
rest goes when the driver's process ends, as a result may read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.plans.lineage import delete, table_dir


class Scratch:
    """Tables of one run; ``free`` deletes one that no later stage reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, table_dir(spark, name), 0

    def save(self, df: DataFrame, compression: str = "zstd", schema: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(schema or df.schema).parquet(path)
        out._loamline_path = path
        return out

    def free(self, df: DataFrame) -> None:
        path = getattr(df, "_loamline_path", None)
        if path:
            delete(self.spark, path)
