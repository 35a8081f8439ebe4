"""What the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillion.session import ship

#: Rows and bytes that one Arrow batch may hold: bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for very long texts, and this package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column (in any case of letters) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns with these names, whatever dots or quotes they hold, each once."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys(names)])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for a function from a batch to columns of ``schema``.

    Columns travel under names of their places, so any name will do.
    """
    small_batches(df.sparkSession)
    names, plain = df.columns, T.StructType([T.StructField(f"o{k}", f.dataType) for k, f in enumerate(schema)])
    want, out_names = to_arrow_schema(plain), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(pa.RecordBatch.from_arrays(b.columns, names))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[n], pa.Array) else pa.array(c, f.type) for n, f in zip(out_names, want, strict=True)], schema=want)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, plain).toDF(*out_names)


def held_out_id(col: str = "doc_id"):
    """True where crc32 of the id's text is divisible by 5: never learnt from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
