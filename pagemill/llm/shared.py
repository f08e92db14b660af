"""What the operators of this package have in common: reading columns safely, cutting lineage, batches of texts."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = (1 << 63) - 1  # rank of a row without id: after every other row
SLICE_BYTES = 4 << 20  # texts worked on together in a Python task


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local session may lack one (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="pagemill-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/pagemill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def rank_of(id_col: str) -> Column:
    """The id as a number to order rows by; rows without id come last."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))


def lower_ascii(column: Column | str) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no helper column can clash with their names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


LOWER = {c: c + 32 for c in range(65, 91)}  # for str.translate: A-Z alone


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(text).nbytes // batch.num_rows)
        step = max(1, most // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole documents go through Python in Arrow batches of so many rows from now on in this session: a batch is held by
    the JVM and by the worker at once, and with texts the default of 10,000 rows is too much for small executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size together with the code of its class; :func:`received` opens it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held: Broadcast):
    return pickle.loads(held.value)
