"""What the training-data operators share: reading tables, checkpoints, word rules, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space and 0x09 to 0x0D.
SPACE_CLASS = r"\x20\x09-\x0D"

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space;
#: bytes from 0x80 on stay, so ``bytes.split()`` then yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's ``spark.checkpoint.dir`` alone; a folder of this machine is taken only where Spark runs in it alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lumaframe-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: written to the shared folder, so that a lost executor costs nothing behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder beside the session's checkpoints, which executors and driver share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again, for what a loop joins round after round.

    A checkpoint keeps the size that was estimated for its plan, and a join multiplies the sizes of its
    sides: over a few rounds the estimate becomes a number of millions of digits, which the
    driver works out for each plan. The size of a written table is that of its files.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def empty(df: DataFrame) -> bool:
    """Whether a table has no rows, in one job over all its partitions."""
    return df.limit(1).count() == 0


def top_rows(df: DataFrame, score: str, most: int) -> tuple[DataFrame, float]:
    """(rows, least score): the rows with the greatest positive scores, at most ``most`` of them.

    A histogram of the scores, in steps of about one per cent, says how far down one can go; steps
    are taken whole. Unlike a sort with a limit, no partition has to offer ``most`` rows of its own.
    """
    step = F.floor(F.log2(score) * 64).cast("long")
    counts = df.where(F.col(score) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("least")).collect()
    total, least = 0, float("inf")
    for r in sorted(counts, key=lambda r: -r.step):
        total += r.n
        if total > most:
            break
        least = r.least
    return df.where(F.col(score) >= least), least


def spread(df: DataFrame) -> int:
    """Partitions for shuffles that must not be coalesced: what the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift) over an unsigned array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without a copy of each value; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def column_bytes(column: pa.Array) -> list[bytes]:
    """Each value's UTF-8 bytes; null reads as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
