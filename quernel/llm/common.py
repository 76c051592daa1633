"""What the operators of this subpackage share: reading columns, staging tables, driving Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word, as the contracts of this subpackage define words.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the columns named in more; every other column is dropped, so extra columns can't clash. Null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in more))


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores after it until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; spark.checkpoint.dir names it. Unset (tests), one below the warehouse is used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df. Only for tables that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def byte_chunks(batch: pa.RecordBatch, most: int = 1 << 20, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts come to about `most` bytes, or one longer text, and the texts as UTF-8; null is empty. The batch is cut by its offsets, so
    no more than a slice becomes Python objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    k = 0
    while k < len(ends):
        before = int(ends[k - 1]) if k else 0
        to = max(k + 1, int(np.searchsorted(ends, before + most, "right")))
        part = batch.slice(k, to - k)
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
        k = to


_resident: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps, between tasks too, as long as no other operator's task runs in it. Workers outlive their operators, so without release() a
    pipeline would carry each stage's tables and caches into all later ones."""
    if name not in _resident:
        release()
        _resident[name] = make()
    return _resident[name]


def release() -> None:
    """Give back what resident() keeps and what allocators hold in this process."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def text_udf(work: Callable[[list[str | None]], pa.Array], kind: str, most: int = 1 << 20, after: Callable[[], None] = release) -> Callable[..., Column]:
    """An Arrow function of a text column. `work` sees slices of about `most` bytes, so what a worker holds doesn't follow the size of an Arrow batch; at the end of a
    task `after` gives back what the worker kept."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            out, k = [], 0
            while k < len(ends):
                to = max(k + 1, int(np.searchsorted(ends, (int(ends[k - 1]) if k else 0) + most, "right")))
                out.append(work(texts.slice(k, to - k).to_pylist()))
                k = to
            yield pa.concat_arrays(out) if out else work([])
        after()

    return run
