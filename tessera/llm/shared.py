"""What the training-data operators share: the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the ``[^\\x20\\x09-\\x0D]+`` word rule, as a Java regex.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder of
    this machine is chosen and recorded, so that later calls agree.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that is read from them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns (of any case) that an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has in no case."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while any(c.startswith(out.lower()) for c in taken):
        out = f"_{out}"
    return out


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) drawn from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
