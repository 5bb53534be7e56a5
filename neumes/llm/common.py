"""What the operators share: intermediate tables, input columns, bounded batches."""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that driver and executors share.

    The latter is read from spark.checkpoint.dir. Where that is unset, a temporary
    folder takes its place in local mode, as in tests; on a cluster that is an error,
    as each executor would write to a disk of its own. The application's folder goes
    when its JVM ends in order.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.gettempdir()
    path = context._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/neumes-{context.applicationId}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession, rows: int = 4096, size: int = 4 << 20) -> None:
    """Lowers the session's bounds of Arrow batches to these, the same for all operators, where they are larger.

    Python code slices what it gets, but only the session bounds what the JVM holds
    beside it; results are lazy, so the bounds stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark._jsparkSession.sessionState().conf()
        held = now.arrowMaxRecordsPerBatch() if name == "maxRecordsPerBatch" else now.arrowMaxBytesPerBatch()
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def pieces(batch: pa.RecordBatch, rows: int, size: int):
    """Slices of a batch with at most so many rows and, but for single larger rows, bytes of text."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    if batch.num_rows <= rows and (not texts or batch.nbytes <= size):
        yield batch
        return
    ends = np.zeros(batch.num_rows, np.int64)
    for c in texts:
        ends += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(ends)
    begin = 0
    while begin < batch.num_rows:
        fits = int(np.searchsorted(ends, size + (int(ends[begin - 1]) if begin else 0), "right"))
        end = min(begin + rows, max(begin + 1, fits))
        yield batch.slice(begin, end - begin)
        begin = min(end, batch.num_rows)


def bounded(run, rows: int = 4096, size: int = 16 << 20):
    """``run`` over batches of bounded rows and bytes, whatever the session's settings."""

    def wrapped(batches):
        return run(piece for batch in batches for piece in pieces(batch, rows, size))

    return wrapped


def in_pieces(run, size: int = 4 << 20):
    """A function of a text column, run over slices of bounded size; freed memory is given back after each column."""

    def wrapped(texts: pa.Array) -> pa.Array:
        out = [run(p.column(0)) for p in pieces(pa.record_batch({"text": texts}), 4096, size)]
        give_back()
        return pa.concat_arrays(out)

    return wrapped


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads; other columns, whatever their names, don't matter.

    Ids are whole numbers of 64 bits, or text of such; other ids raise an error.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def word_hashes(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin and end.

    ``table`` maps each byte of UTF-8 to one of a word, or to a blank between words; null has no words.
    """
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = bytes(memoryview(texts.buffers()[2])[at[0] : at[-1]]) if at[-1] > at[0] else b""
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data.translate(table))])
    split = pc.ascii_split_whitespace(plain)
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    stream = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.uint64)
    real = np.array([w != b"" for w in names], bool)[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return stream[real], np.concatenate([[0], np.cumsum(real)])[ends]


def utf8(column: pa.Array) -> list:
    """The texts of an Arrow column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run):
    """``run`` over batches, with freed memory given back at its end: idle workers stay small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col) -> "F.Column":
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3
