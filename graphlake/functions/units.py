"""Unit conversion of a table of values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From, to, factor. The other direction divides.
FACTORS = [
    ("m", "ft", 1 / 0.3048), ("ft", "m", 0.3048), ("km", "mi", 0.621371), ("psi", "kPa", 6.89476), ("bar", "psi", 14.5038),
    ("bbl", "m3", 0.158987), ("mcf", "m3", 28.3168), ("g/cm3", "kg/m3", 1000.0), ("gal", "L", 3.78541),
]


def convert(values: DataFrame) -> DataFrame:
    """values (value, from_unit, to_unit, ...): adds converted, null for a pair that isn't known.

    Same unit: the value. C, F and K by formula. Else the factor of the pair, or of its reverse.
    """
    spark = values.sparkSession
    table = spark.createDataFrame(FACTORS, "from_ string, to_ string, factor double")  # a fixed list
    direct = F.broadcast(table.toDF("from_unit", "to_unit", "direct"))
    reverse = F.broadcast(table.toDF("to_unit", "from_unit", "reverse"))
    v, a, b = F.col("value"), F.col("from_unit"), F.col("to_unit")
    kelvin = F.when(a == "C", v + 273.15).when(a == "F", (v - 32) * 5 / 9 + 273.15).when(a == "K", v)
    heat = F.when(b == "C", kelvin - 273.15).when(b == "F", (kelvin - 273.15) * 9 / 5 + 32).when(b == "K", kelvin)
    out = F.when(a == b, v).otherwise(F.coalesce(heat, v * F.col("direct"), v / F.col("reverse")))
    return values.join(direct, ["from_unit", "to_unit"], "left").join(reverse, ["from_unit", "to_unit"], "left").withColumn("converted", out).drop("direct", "reverse")
