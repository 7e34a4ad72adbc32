"""Helpers the operators share: tables, shared-folder writes, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id orders after every other id.
LAST_ID = (1 << 63) - 1
#: Bytes of a Parquet row group that holds large binary cells.
BLOB_ROW_GROUP = 8 << 20
#: Bytes of a page of such cells, within which alike ones are found.
BLOB_PAGE = 4 << 20
#: Bytes of an Arrow batch on its way to Python; Spark's own bound (64 MB, 10,000 rows) is too much for whole texts.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only in local mode, where none is configured, is a temporary one made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str, blobs: bool = False, level: int = 3) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    if blobs:
        out = out.option("parquet.block.size", BLOB_ROW_GROUP).option("parquet.page.size", BLOB_PAGE)
    out.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._tessera_path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `most` bytes of column `col`, one row at least."""
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(col)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def to_python(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of about BATCH bytes, or of what the session sets below Spark's own bound."""
    conf = df.sparkSession.conf
    if int(re.match(r"\d+", conf.get(BATCH_SETTING))[0]) >= 64 << 20:
        conf.set(BATCH_SETTING, str(BATCH))
    return df.mapInArrow(f, schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, col: str, most: int = 4 << 20) -> DataFrame:
    """Apply f to bounded slices; f returns a dict of columns in the order of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in chunks(batches, col, most):
            got = f(b)
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) if not isinstance(got[x.name], pa.Array) else got[x.name].cast(x.type) for x in arrow], schema=arrow)

    return to_python(df, run, schema)
