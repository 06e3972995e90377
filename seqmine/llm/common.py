"""What the operators of this subpackage share: reading, shared storage, batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that Spark sends to a Python worker (one row at least); Spark's own limit is 64 MB
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string): whatever else the input has stays unread."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share, with a part for each application.
    Only a local session may go without: it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="seqmine-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/seqmine-{spark.conf.get('spark.app.id')}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Has Spark send BATCH_BYTES at most to a worker at once, for the rest of the session; a lower limit stays. Its 64 MB
    hold a whole split of texts, which JVM and worker both keep several times over for each core."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < jvm.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a worker has freed back to the system; without it a worker stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes of text (one row at least), so that memory stays bounded."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(col.type)
        offsets = pa.Array.from_buffers(pa.int64() if wide else pa.int32(), n + 1, [None, col.buffers()[1]], offset=col.offset).to_numpy()
        start = 0
        while start < n:
            stop = start + 1
            # the furthest row whose text still ends within the budget
            limit = int(offsets[start]) + max_bytes
            stop = max(stop, int(offsets.searchsorted(limit, side="right")) - 1)
            stop = min(stop, n)
            yield batch.slice(start, stop - start)
            start = stop
