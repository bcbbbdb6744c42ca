"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Extension -> language of the source files that the operators read as code.
LANGUAGE_OF_EXTENSION = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "go": "go"}

_EXT = re.compile(r"\.([A-Za-z0-9]+)$")


def language_of_path(path: str | None) -> str | None:
    """Language by the extension of the last path component, None for anything else."""
    if not path:
        return None
    m = _EXT.search(path.replace("\\", "/").rsplit("/", 1)[-1])
    return LANGUAGE_OF_EXTENSION.get(m.group(1).lower()) if m else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """At least `per_core` partitions per core for a CPU-bound Python stage.

    A table that already comes in enough partitions (any large one) passes
    through without a shuffle; only inputs of a few files are redistributed.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() * 2 >= want else df.repartition(want)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """mapInArrow where `rows` turns the columns of one batch, as lists, into tuples.

    Output is cut into chunks so that one input batch cannot become one huge
    output batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: list[tuple] = []
            for row in rows(cols):
                out.append(row)
                if len(out) >= 20000:
                    yield _batch(out, arrow_schema)
                    out = []
            if out:
                yield _batch(out, arrow_schema)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine for sessions on this machine only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: later steps survive lost executors. The table is deleted when the session's process ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
