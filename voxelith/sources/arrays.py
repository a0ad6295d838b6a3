"""Arrays, named features and graphs as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element classes and their Spark types; unsigned ones take the next wider type.
ELEMENTS = {
    "double": "double",
    "single": "float",
    "int32": "int",
    "uint32": "bigint",
    "int16": "smallint",
    "uint16": "int",
    "int8": "tinyint",
    "uint8": "smallint",
    "char": "smallint",
    "logical": "boolean",
}


def load_array(df: DataFrame, array: str, dims: tuple[int, ...], element: str = "double", key: str = "vol_id") -> DataFrame:
    """key, x, y, z, t, val from a flat array per row, x fastest; an unknown element class is an error."""
    if element not in ELEMENTS:
        raise ValueError(f"unknown element class {element!r}")
    rows = df.select(F.col(key), F.posexplode(array).alias("i", "val"))
    out, index = [], F.col("i")
    for a, n in zip("xyzt", (*dims, 1, 1, 1, 1)):
        out.append((index % n).cast("int").alias(a))
        index = F.floor(index / n)
    return rows.select(F.col(key).cast("bigint").alias("vol_id"), *out, F.col("val").cast(ELEMENTS[element]).alias("val"))


def load_scalar(df: DataFrame, array: str, default=None) -> Column:
    """The first element of an array column, or the default where it is empty."""
    return F.coalesce(F.get(F.col(array), F.lit(0)), F.lit(default))


def store_scalar(spark, value, element: str = "double") -> DataFrame:
    """One row with one value of an element class; an unknown class is an error."""
    if element not in ELEMENTS:
        raise ValueError(f"unknown element class {element!r}")
    return spark.range(1).select(F.lit(value).cast(ELEMENTS[element]).alias("value"))


def read_gamma(spark, path: str, dim: int) -> tuple[float, float, DataFrame]:
    """tau, lambda and the four neighbour matrices (m 1..4, i, j, value) of a text file of numbers: tau, lambda, then the matrices by rows.

    Numbers left out at the end are an error, further ones are ignored.
    """
    words = spark.read.text(path, wholetext=True).first()[0].split()[: 2 + 4 * dim * dim]
    values = [float(w) for w in words]
    if len(values) < 2 + 4 * dim * dim:
        raise ValueError(f"{path}: {len(values)} numbers, {2 + 4 * dim * dim} wanted")
    cells = [(k // dim**2 + 1, k // dim % dim, k % dim, v) for k, v in enumerate(values[2:])]
    return values[0], values[1], spark.createDataFrame(cells, "m int, i int, j int, value double")


def store_array(vox: DataFrame, dims: tuple[int, ...], element: str = "double", value: str = "val") -> DataFrame:
    """vol_id, data: flat arrays in index order. A volume's array is one value, so this is for volumes that fit one."""
    nx, ny, nz = (*dims, 1, 1, 1)[:3]
    index = F.col("x").cast("long") + nx * (F.col("y") + ny * (F.col("z") + nz * F.col("t").cast("long")))
    packed = vox.groupBy("vol_id").agg(F.sort_array(F.collect_list(F.struct(index.alias("i"), F.col(value).cast(ELEMENTS[element]).alias("v")))).alias("p"))
    return packed.select("vol_id", F.col("p.v").alias("data"))


def store_ragged(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, cells: values of each key in order, an array of any length."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("p")).select(key, F.col(f"p.{value}").alias("cells"))


def named_features(wide: DataFrame, key: str) -> DataFrame:
    """key, name, value: one row for each column beside key."""
    names = [c for c in wide.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
    return wide.select(key, F.explode(pairs).alias("f")).select(key, "f.name", "f.value")


def features_map(long: DataFrame, key: str) -> DataFrame:
    """key, features: a map of names and values."""
    return long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("features"))


def dump_text(vox: DataFrame, path: str, value: str = "val") -> None:
    """One value per line in index order, in range-partitioned part files."""
    ordered = vox.select("vol_id", "t", "z", "y", "x", F.col(value).cast("string").alias("value")).repartitionByRange("vol_id", "t", "z", "y", "x").sortWithinPartitions("vol_id", "t", "z", "y", "x")
    ordered.select("value").write.text(path)


def load_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) with both ends among the vertices (node), and the other ones, which are errors."""
    ends = edges.join(vertices.select(F.col("node").alias("a")).distinct().withColumn("has_a", F.lit(1)), "a", "left").join(vertices.select(F.col("node").alias("b")).distinct().withColumn("has_b", F.lit(1)), "b", "left")
    ok = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    return ends.where(ok).select("a", "b", "w"), ends.where(~ok).select("a", "b", "w")
