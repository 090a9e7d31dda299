"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* inputs are DataFrames; only the columns named in the docstring are read, so
  extra columns, whatever their names, never clash with the operator's own;
* a null text counts as the empty text, a null key forms its own group;
* an empty table gives an empty result with the documented schema;
* intermediate tables go to the folder in ``spark.checkpoint.dir``, which the
  driver and all executors share, and are written by Spark's own committers, so
  that a lost executor costs a retry and nothing else.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to the workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: What counts as white space between words: the six ASCII characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and there is no cluster (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/proofloom/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, on whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame from :func:`saved`."""
    remove(df.sparkSession, df.saved_path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def n_blocks(df: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> int:
    """Blocks of about ``size`` bytes that the texts of ``df`` fill, at least 1."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(total // size) + 1


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a bitmap that goes to all tasks, at most (16 MB), and of each of its rows, the size that Spark's bitmap functions have.
SIEVE_BITS, PAGE_BITS = 1 << 27, 1 << 15


def may_match(rows: DataFrame, keys: DataFrame, on: list[str], most: int = SIEVE_BITS) -> DataFrame:
    """``rows`` with a column ``may``: false where no row of ``keys`` has these values of the columns ``on``.

    A bitmap of hashes goes to all tasks, so that wide rows without a match need
    no shuffle. About one in 16 of those without a match, or more beyond ``most``
    bits, has ``may`` too: an exact join is to follow.
    """
    bits = max(min(1 << (16 * keys.count()).bit_length(), most), PAGE_BITS)
    bit = F.pmod(F.xxhash64(*on), F.lit(bits))
    page = keys.groupBy(F.floor(bit / PAGE_BITS).alias("_page")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(PAGE_BITS))).alias("_bits"))
    page = saved(page, "sieve")
    at = F.pmod(bit, F.lit(PAGE_BITS))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_page", F.floor(bit / PAGE_BITS)).join(F.broadcast(page), "_page", "left").select(*[F.col(f"`{c}`") for c in rows.columns], may.alias("may"))


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Arrow batches of whole texts stay small in the workers: about ``size`` bytes at most in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Give freed memory back to the system: a reused worker would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, for values that any task may compute again."""
    home = sys.modules.setdefault("proofloom_worker_cache", types.ModuleType("proofloom_worker_cache"))
    return home.__dict__.setdefault(name, {})


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered; bytes.split() splits at \\x20 and \\x09-\\x0D."""
    return text.translate(LOWER).split()


def identifier(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a column name: {name!r}")
    return name
