"""What the operators of this subpackage share: tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space of the text contracts; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\r\x0b\x0c"
#: Bytes of a written table's file, about: what adaptive execution aims at too where it is on.
FILE = 8 << 20
#: Bytes of a row group that Python writes.
GROUP = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share. Unset, a local master gets one of its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "tessella")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, like: DataFrame | None = None, less: int = 1) -> DataFrame:
    """Write df below the shared folder and read it back: this cuts its lineage, and a lost executor costs a re-read only.

    like: a table that df is not much larger than, or less than a `less`th of; df then has a file for every FILE bytes of that at most, however many
    partitions it came in.
    """
    if like is not None:
        df = df.coalesce(max(6, min(200_000, input_bytes(like) // (FILE * less))))
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _hadoop(df.sparkSession, path)
    fs.deleteOnExit(at)  # what no one drops before goes with the session
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str, like: DataFrame | None = None) -> DataFrame:
    """Like materialize(df.mapInArrow(function, schema)), but the Python workers write the files, so the rows don't go back through the JVM.

    A task writes beside its place and moves the file there, under a name that its partition gives: one that runs again writes the same.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    if like is not None:
        df = df.coalesce(max(6, min(200_000, input_bytes(like) // FILE)))

    def write(batches):
        import pyarrow.parquet as pq

        files, root = file_system(path)
        part = TaskContext.get().partitionId()
        beside, writer, held, size, n = f"{root}/_part-{part:06d}-{uuid.uuid4().hex}", None, [], 0, 0

        def flush():
            nonlocal writer, held, size, n
            if held:
                writer = writer or pq.ParquetWriter(files.open_output_stream(beside), kinds, compression="zstd")
                rows_ = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, kinds.names) for b in held]).cast(kinds)
                writer.write_table(rows_)
                n, held, size = n + rows_.num_rows, [], 0

        for batch in function(batches):
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size > GROUP:
                    flush()
        flush()
        if writer:
            writer.close()
            move_file(files, beside, f"{root}/part-{part:06d}.parquet")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return spark.read.schema(schema).parquet(path)


def move_file(files, beside: str, to: str) -> None:
    """One that another run of the task left there is the same."""
    size = files.get_file_info(beside).size
    try:
        files.move(beside, to)
    except OSError:  # a file system whose move doesn't replace
        if files.get_file_info(to).size != size:
            raise
        files.delete_file(beside)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def file_system(path: str):
    """pyarrow's file system of a path or URI of the shared folder, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


def drop(*written: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at, fs = _hadoop(df.sparkSession, folder)
            fs.delete(at, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Python gets Arrow batches of at most this size; a batch of 10,000 long texts would not fit beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the plan: for a file scan, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions of about so many input bytes, and no fewer than the session asks for."""
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, input_bytes(df) // each))


def rows(batches: Iterator[pa.RecordBatch], each: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose columns hold at most about so many bytes, one row at least."""
    for batch in batches:
        n = max(1, -(-batch.nbytes // each))
        step = max(1, -(-batch.num_rows // n))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def per_text(function: Callable[[str | None], tuple], columns: list[tuple[str, pa.DataType]]):
    """For mapInArrow over (id, text): the id and what function makes of each text."""

    def run(batches):
        for batch in rows(batches):
            found = [function(x) for x in batch.column(1).to_pylist()]
            arrays = [batch.column(0)] + [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], *(name for name, _ in columns)])

    return run


def gather(starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen runs (start, length) laid end to end, and where each run ends."""
    n = lengths[chosen].astype(np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts[chosen].astype(np.int64) - (ends - n), n), ends
