"""What the operators share: shared-folder tables and small Column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's regular expression for the words of most contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs on one machine (tests) a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders of the tables settled by the run at hand, if it keeps a list (see ``collecting``).
_SETTLED: ContextVar[list[str] | None] = ContextVar("settled", default=None)


@contextmanager
def collecting(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end, once what was made of them is written; a run has its own list."""
    mine: list[str] = []
    token = _SETTLED.set(mine)
    try:
        yield
    finally:
        _SETTLED.reset(token)
        for folder in mine:
            delete(spark, folder)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage,
    and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _SETTLED.get()) is not None:
        mine.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        delete(df.sparkSession, folder)


def bit_map(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of fixed size with a bit for each value of a long column, for scans to skip most other rows.
    Bits are set in the tasks; at most bits / 32 words come to the driver.  ``bits``: a power of two."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select(F.shiftright(at, 5).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out


def marked(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which places, as ``pmod(xxhash64(value), bits)``, are set."""
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns under names that no operator uses, and these names by the old ones."""
    names = {c: f"__{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(names: dict[str, str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a hidden table under their old names, less those that results replace."""
    return [F.col(h).alias(c) for c, h in names.items() if c not in without]


def spread(key: Column, seed: int = 0) -> Column:
    """60 bits that any SQL engine can repeat: of the MD5 of a key's text (null as the empty text)."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
