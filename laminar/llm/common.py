"""What the operators of this subpackage share: shared scratch tables, input reading, hashing helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one is set only in local mode."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_laminar_scratch", None)
    if own is None:
        made = tempfile.mkdtemp(prefix="laminar-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        own = f"file://{made}"
        spark.sparkContext._laminar_scratch = own
    return own


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/laminar-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._laminar_path = path
    scratch(spark).append(path)
    sweep(spark)
    return written


def sweep(spark: SparkSession) -> None:
    """Let go of what finished jobs hold. Spark removes the shuffle files and broadcasts of a plan when the driver collects it,
    which a driver with a large heap may do hours later; a pipeline of many written tables would hold them all."""
    gc.collect()
    spark._jvm.System.gc()


def scratch(spark: SparkSession) -> list[str]:
    """The scratch tables that this session has written and not removed, in order."""
    context = spark.sparkContext
    if not hasattr(context, "_laminar_tables"):
        context._laminar_tables = []
    return context._laminar_tables


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    scratch(spark).remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove the tables of stash() that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._laminar_path)


def discard_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Remove the tables written since len(scratch(spark)) was mark, but for some."""
    stay = {df._laminar_path for df in but}
    for path in scratch(spark)[mark:]:
        if path not in stay:
            _remove(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this session; results that haven't been written yet can't be read after that."""
    for path in list(scratch(spark)):
        _remove(spark, path)


#: Caches that a Python worker keeps between tasks.
_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """cache, to be emptied by release()."""
    _KEPT.append(cache)
    return cache


def release() -> None:
    """Empty the caches that other operators have left in this worker, for operators that need the memory themselves."""
    if any(_KEPT):
        for cache in _KEPT:
            cache.clear()
        gc.collect()


def plain(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with all columns but `keep` renamed c0, c1, ..., so that no name a caller uses can clash with one used here."""
    return docs.toDF(*[c if c in keep else f"c{k}" for k, c in enumerate(docs.columns)])


def as_in(df: DataFrame, docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of plain(docs, *keep) that df still has, under their own names and in their order."""
    return df.select(*plain(docs, *keep).columns).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
