"""Reading feature tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_features(
    spark: SparkSession, path: str, fmt: str = "parquet", num_features: int | None = None,
    sparse: bool = False, **options,
) -> DataFrame:
    """Read a feature table from any Hadoop path.

    LibSVM text gives `(label, features array<double>)`; name `num_features` where it is known,
    else Spark reads the files once more to find it. Other formats are read as they are, with
    ML vector columns turned into arrays. With `sparse` such columns stay ML vectors, which training
    keeps as sparse as they are.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "libsvm" and num_features:
        reader = reader.option("numFeatures", str(num_features))
    df = reader.load(path)
    if sparse:
        return df
    vectors = [f.name for f in df.schema if isinstance(f.dataType, VectorUDT)]
    return df.withColumns({c: vector_to_array(F.col(c)) for c in vectors}) if vectors else df


def write_libsvm(df: DataFrame, path: str, label: str, features: str) -> None:
    """Write an array column as LibSVM text: 1-based positions, zeros left out."""
    cells = F.transform(
        F.col(features),
        lambda v, i: F.when(v != 0, F.concat((i + 1).cast("string"), F.lit(":"),
                                             v.cast("double").cast("string"))),
    )
    label_text = F.col(label).cast("double").cast("string")
    line = F.concat_ws(" ", label_text, F.array_join(F.array_compact(cells), " "))
    df.select(F.trim(line).alias("value")).write.text(path)
