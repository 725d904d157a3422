"""Helpers shared by the training-data operators.

Rules kept by every operator here:

* documents stay distributed; only bounded model samples and scalars reach the driver;
* intermediate results that must be stable or are read twice are written as Parquet under
  ``spark.checkpoint.dir`` (the folder all executors share), never to a local folder and never
  with ``localCheckpoint``;
* input columns other than the named id and text columns may have any name and type.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows and bytes of one Arrow batch sent to Python: bounds a worker's memory with long texts.
ARROW_ROWS = 500
ARROW_BYTES = 8 * 1024 * 1024


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tarmac_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tarmac-pyfiles-")) / "tarmac_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._tarmac_shipped = True


def prepare_session(spark: SparkSession) -> SparkSession:
    """The package on the executors; Arrow batches small enough for long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tarmac-llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, so a lost
    executor costs a file read and nondeterministic tags stay as they are."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of narrow rows if it was counted small; else let the planner join
    it by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def quoted(name: str) -> Column:
    """Column by literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_mod(id_col: Column, mod: int) -> Column:
    """``crc32(id as text) mod m``, the fold of a row."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def append(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    names = list(batch.schema.names) + list(extra)
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=names)


Batches = Iterator[pa.RecordBatch]
