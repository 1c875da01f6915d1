"""CSV files: reading with rescued lines, writing from typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued_data"
#: Empty text reads as NULL; a line that doesn't fit keeps its row and is kept whole; a header that doesn't match is an error.
OPTIONS = {"header": "true", "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED, "enforceSchema": "false", "dateFormat": "yyyy-MM-dd"}


def with_rescued(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(with_rescued(schema)).options(**OPTIONS).csv(path).withColumn("_source_file", F.col("_metadata.file_path"))


def stream_csv(spark: SparkSession, path: str, schema: T.StructType, archive: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder; with an archive, processed files move there."""
    r = spark.readStream.schema(with_rescued(schema)).options(**OPTIONS)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.csv(path).withColumn("_source_file", F.col("_metadata.file_path"))


def write_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists", codec: str = "none") -> None:
    (df.coalesce(files) if files else df).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("compression", codec).csv(path)
