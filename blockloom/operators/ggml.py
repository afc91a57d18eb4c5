"""Quantised tensor types: names and storage, as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (type id, name, bytes per block, elements per block); null where the storage is not known.
TYPES = (
    (0, "F32", 4, 1),
    (1, "F16", 2, 1),
    (2, "Q4_0", 18, 32),
    (3, "Q4_1", 20, 32),
    (6, "Q5_0", 22, 32),
    (7, "Q5_1", 24, 32),
    (8, "Q8_0", 34, 32),
    (9, "Q8_1", 36, 32),
    (10, "Q2_K", 84, 256),
    (11, "Q3_K", 110, 256),
    (12, "Q4_K", 144, 256),
    (13, "Q5_K", 176, 256),
    (14, "Q6_K", 210, 256),
    (15, "Q8_K", 292, 256),
    (16, "IQ2_XXS", None, None),
    (17, "IQ2_XS", None, None),
    (18, "IQ3_XXS", None, None),
    (19, "IQ1_S", None, None),
    (20, "IQ4_NL", None, None),
    (21, "IQ3_S", None, None),
    (22, "IQ2_S", None, None),
    (23, "IQ4_XS", None, None),
    (24, "I8", None, None),
    (25, "I16", None, None),
    (26, "I32", None, None),
    (27, "F64", None, None),
    (28, "IQ1_M", None, None),
    (29, "BF16", 2, 1),
    (30, "Q4_0_4_4", None, None),
    (31, "Q4_0_4_8", None, None),
    (32, "Q4_0_8_8", None, None),
)
NOT_QUANTISED = ("F32", "F16", "BF16", "F64")


def types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPES), "type_id int, type_name string, block_bytes int, block_elements int")


def described(tensors: DataFrame) -> DataFrame:
    """Tensors (type_id, shape) with type name (the id itself if unknown), estimated bytes and is_quantised."""
    t = tensors.join(F.broadcast(types(tensors.sparkSession)), "type_id", "left")
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    size = F.when(F.size("shape") > 0, F.ceil(elements / F.col("block_elements")) * F.col("block_bytes"))
    name = F.coalesce("type_name", F.col("type_id").cast("string"))
    return t.withColumn("ggml_type", name).withColumn("estimated_size", size.cast("long")).withColumn("is_quantised", ~name.isin(*NOT_QUANTISED))
