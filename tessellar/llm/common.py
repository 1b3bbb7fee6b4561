"""What the operators share: the folder for intermediate tables, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = "\x20\t\n\x0b\x0c\r"


_OWN: dict[str, str] = {}  # application -> the folder made for a local session
_WRITTEN: dict[str, list[str]] = {}  # application -> folders of intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessellar-")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables and archives that this application wrote, once their results are stored elsewhere."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: a cut in the lineage that outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """mapInArrow of a function from one batch to a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            out = step(batch)
            if out is not None:
                kinds = kinds or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def words(text: str | None) -> list[str]:
    """The words of a text; none for null. Only ASCII white space parts words."""
    return [w for w in (text or "").translate(_TO_SPACE).split(" ") if w]


_TO_SPACE = {ord(c): " " for c in WHITE}


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
