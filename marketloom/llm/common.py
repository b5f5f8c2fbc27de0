"""What the operators of this folder share: inputs, intermediate tables, and free column names."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters from tab to carriage return,
#: which is what ``bytes.split()`` splits at.
WORD = "[^\\x20\\x09-\\x0D]+"
#: For tables whose rows may have megabytes: Parquet's writer holds pages and groups of rows in memory, and looks at their size
#: after 100 rows only unless told otherwise.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends at files that all executors see. ``wide``: see ``WIDE``."""
    path = shared_folder(df.sparkSession)
    df.write.options(**WIDE if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark, rows: int, read: int | None = None):
    """Jobs started inside hand Python Arrow batches of at most ``rows`` rows, and read Parquet ``read`` rows at a time if it is given."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": read}
    wanted = {name: n for name, n in wanted.items() if n is not None}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, n in wanted.items():
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        for name, n in before.items():
            spark.conf.set(name, n)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(key: str | Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text is a multiple of five."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def rows_and_max(df: DataFrame, *columns: str) -> dict:
    """One row: how many rows there are and the largest value of each column."""
    return df.agg(F.count("*").alias("rows"), *(F.max(c).alias(c) for c in columns)).first().asDict()


def parts(amount: float, size: float, least: int = 1) -> int:
    """How many parts of at most ``size`` hold ``amount``."""
    return max(least, math.ceil(amount / size))


def slices(values: Iterable[bytes | None], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes with the place of each run; a longer text stands alone. None is empty."""
    run, held, start, i = [], 0, 0, -1
    for i, value in enumerate(values):
        value = value or b""
        if run and held + len(value) > limit:
            yield start, run
            run, held, start = [], 0, i
        run.append(value)
        held += len(value)
    if run:
        yield start, run


def texts(array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string array."""
    import pyarrow as pa

    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(31)
    return values
