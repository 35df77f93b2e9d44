"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: XXH64 seed used by Spark's xxhash64().
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only where a local session names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` for at most ``rows`` narrow rows, in files of about 100,000 (8 files at least, never more than there are)."""
    return cut(df.coalesce(max(8, -(-rows // 100_000))))


_WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, which ``clean`` deletes."""
    _WRITTEN.append(f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder (smaller than a checkpoint)."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables this process wrote on the way; call it once the results that read them are saved.

    Checkpoints are deleted by Spark itself where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    files = spark._jvm.org.apache.hadoop.fs
    for path in _WRITTEN:
        where = files.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gone = len(_WRITTEN)
    _WRITTEN.clear()
    return gone


#: Narrow rows that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(rows: DataFrame) -> DataFrame:
    """A broadcast of narrow rows where their counted number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def md5_unit(*parts: Column | str) -> Column:
    """A uniform double in (0, 1] from the first 52 bits of an MD5 over the joined parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(1)) / F.lit(float(1 << 52))


def key_text(col: Column) -> Column:
    """A column as text for hashing; null has a text of its own."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def spaced(text: Column, marks: str) -> Column:
    """``text`` with each of the characters ``marks`` replaced by a blank."""
    for c in marks:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(spaced(F.coalesce(text, F.lit("")), SPACES), " "), "")


#: Rows and text bytes a worker takes at once from an Arrow batch (Spark bounds a batch's bytes itself).
SLICE_ROWS, SLICE_BYTES = 500, 1 << 21


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut, without copying, where ``SLICE_ROWS`` rows or ``SLICE_BYTES`` bytes of column ``text`` are full."""
    for b in batches:
        if not b.num_rows:
            yield b
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
            yield b.slice(at, end - at)
            at = end


class Numbers(dict):
    """Words by number; a new word takes the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n
