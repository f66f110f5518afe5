"""What the operators share: reading tables, tables cut off from their lineage, code for the executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonepoint.plans.ship import ship

#: Rows and bytes of text that one Arrow batch holds at most, so that Python workers stay small.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and make this package importable on its executors."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        value = int(now) if now and now.lstrip("-").isdigit() else 0
        if value <= 0 or value > most:
            spark.conf.set(key, str(most))
    ship(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if got := sc._jsc.sc().getCheckpointDir().nonEmpty() and sc._jsc.sc().getCheckpointDir().get():
        return got.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lonepoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Shuffle partitions whose rows a narrow table has in one file.
FEWER = 16
#: Hadoop's local file system starts three programs for each file that it makes, to set permissions of it and of its checksums, and
#: each has the executor's memory for a moment; without checksums it is one. Other file systems take no notice of these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, name: str = "t", narrow: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it has no lineage, and lost executors take nothing of it away.

    A narrow table, of a few numbers for some of the rows, is dealt to fewer tasks first: its files would be tiny, and making
    them costs more than their rows. The folder goes when the JVM ends, or before by discard().
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FEWER))
    path = f"{shared_dir(spark)}/lonepoint-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._lonepoint_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote; only for tables that no returned plan reads."""
    if path := getattr(df, "_lonepoint_path", None):
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text has remainder 2 by 4. A null id counts as empty text (remainder 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_hash(text: Column) -> Column:
    """With the id, tells rows apart: rows equal in both are repeats of one another and are treated alike."""
    return F.xxhash64(text)
