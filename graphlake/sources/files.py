"""File sources: delimited tables with two header rows, nested time series, well-log headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.sources import readers
from graphlake.sources.readers import header_names  # noqa: F401


def cell(value: Column) -> Column:
    """A blank cell is null; a number is written as the number it is, other text is trimmed."""
    plain = T.missing(F.trim(value))
    whole = F.when(plain.rlike(r"^[-+]?[0-9]+$"), plain.try_cast("long").cast("string"))
    return F.coalesce(whole, F.when(F.contains(plain, F.lit(".")), plain.try_cast("double").cast("string")), plain)


def two_header_columns(spark: SparkSession, path: str) -> list[str]:
    """The distinct column names of all files under path, in the order of the least column number and file that has them."""
    readers.register(spark)
    heads = spark.read.format("two_header_csv").option("headersOnly", True).load(path)
    named = heads.select(F.map_keys("cells")[0].alias("name"), F.struct("row", "file").alias("at"))
    return [r.name for r in named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at").collect()]  # bounded by the columns


def two_header_rows(spark: SparkSession, path: str, multiline: bool = True, split_bytes: int = readers.SPLIT) -> DataFrame:
    """(file, split, row, cells map): rows of all files under path, each under its own two header rows; blank cells and rows are
    left out. Without multiline, for files whose quoted cells have no line breaks, large files are cut."""
    readers.register(spark)
    rows = spark.read.format("two_header_csv").option("multiLine", multiline).option("splitBytes", split_bytes).load(path)
    cells = F.map_filter(F.transform_values("cells", lambda _, v: cell(v)), lambda _, v: v.isNotNull())
    return rows.select("file", "split", "row", cells.alias("cells")).where(F.size("cells") > 0)


def read_two_header_csv(spark: SparkSession, path: str, multiline: bool = True, split_bytes: int = readers.SPLIT) -> DataFrame:
    """The same with a column for each name that any file has, null where a file lacks it. Only names reach the driver."""
    rows = two_header_rows(spark, path, multiline, split_bytes)
    return rows.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in two_header_columns(spark, path)])


_SERIES = """value struct<timeSeries: array<struct<
    sourceInfo: struct<siteName: string, siteCode: array<struct<value: string>>>,
    variable: struct<variableDescription: string, variableCode: array<struct<value: string>>>,
    values: array<struct<qualifier: array<struct<qualifierCode: string>>, method: array<struct<methodID: string>>,
        value: array<struct<value: string, dateTime: string, qualifiers: array<string>>>>>>>>"""


def read_time_series(spark: SparkSession, path: str) -> DataFrame:
    """Eight text columns and, beside them, `ts` and `number`: one row for each value of each block of each series.

    The qualifiers of an entry, else of its block, else null; the first site, variable and method.
    """
    doc = spark.read.schema(_SERIES).json(path, multiLine=True)
    series = doc.select(F.explode("value.timeSeries").alias("s"))
    block = series.select("s", F.explode("s.values").alias("b"))
    entry = block.select("s", "b", F.explode("b.value").alias("e"))
    codes = F.col("b.qualifier.qualifierCode")
    qualifiers = F.when(F.size("e.qualifiers") > 0, F.array_join("e.qualifiers", ",")).when(F.size(codes) > 0, F.array_join(codes, ","))
    return entry.select(
        F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site_code"), F.col("s.sourceInfo.siteName").alias("site_name"),
        F.get("s.variable.variableCode", F.lit(0))["value"].alias("variable_code"), F.col("s.variable.variableDescription").alias("variable_name"),
        F.col("e.dateTime").alias("datetime"), F.col("e.value").alias("value"), qualifiers.alias("qualifiers"), F.get("b.method", F.lit(0))["methodID"].alias("method_id"),
        F.try_to_timestamp("e.dateTime").alias("ts"), F.col("e.value").try_cast("double").alias("number"),
    )


def log_lines(spark: SparkSession, path: str, header_only: bool = False) -> DataFrame:
    """(file, pos, line, section) of well-log files, streamed by `readers.WellLog`: no shuffle, no file held whole."""
    readers.register(spark)
    return spark.read.format("well_log").option("headerOnly", header_only).load(path)


def _fields(lines: DataFrame, section: str) -> DataFrame:
    named = lines.where(F.startswith("section", F.lit(section)) & ~F.col("line").rlike("^[~#]") & F.contains("line", F.lit(":")))
    left = F.trim(F.substring_index("line", ":", 1))
    dotted = F.contains(left, F.lit("."))
    return named.select("file", "pos", left.alias("left"), dotted.alias("dotted"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("description"))


def well_section(lines: DataFrame) -> DataFrame:
    """(file, metadata map) of the ~Well sections; of repeated keys the last holds.

    The key is what stands before the first dot; the value is what follows the first word after it, that word where nothing
    does (so a value of several words without a unit loses its first). Without a dot: the first word, and the rest.
    """
    f = _fields(lines, "~WELL")
    after = F.regexp_extract("left", r"^[^.]*\.(.*)$", 1)
    word, rest = F.regexp_extract(after, r"^\s*(\S+)", 1), F.trim(F.regexp_extract(after, r"^\s*\S+\s+(.*)$", 1))
    key = F.upper(F.trim(F.when(F.col("dotted"), F.substring_index("left", ".", 1)).otherwise(F.regexp_extract("left", r"^(\S+)", 1))))
    value = F.when(F.col("dotted"), F.coalesce(T.missing(rest), word)).otherwise(F.trim(F.regexp_extract("left", r"^\S+\s*(.*)$", 1)))
    last = f.select("file", "pos", key.alias("k"), value.alias("v")).where("k <> ''").groupBy("file", "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))


def curve_section(lines: DataFrame) -> DataFrame:
    """(file, pos, mnemonic, unit, description) of the ~Curve sections, in file order."""
    f = _fields(lines, "~CURVE")
    unit = F.regexp_extract("left", r"^[^.]*\.(\S*)", 1)
    mnemonic = F.trim(F.when(F.col("dotted"), F.substring_index("left", ".", 1)).otherwise(F.col("left")))
    return f.select("file", "pos", mnemonic.alias("mnemonic"), F.when(F.col("dotted"), unit).otherwise("").alias("unit"), "description")


def comment_metadata(lines: DataFrame) -> DataFrame:
    """(file, metadata map) of `# key ...: rest` lines: the first word, lower-cased, and what follows the colon."""
    found = lines.where(F.startswith("line", F.lit("#")) & F.contains("line", F.lit(":")))
    key = F.lower(F.regexp_extract("line", r"^#\s*([^\s:]+)", 1))
    last = found.select("file", "pos", key.alias("k"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("v")).groupBy("file", "k").agg(F.max_by("v", "pos").alias("v"))
    return last.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))


def newest_file(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified) of the file changed last; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))


def head_of_files(spark: SparkSession, path: str, lines: int = 100) -> DataFrame:
    """(file, head, truncated) of each file's first lines."""
    from graphlake.sources.tables import head

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), *head(F.col("value"), lines))
