"""Readers and writers of systems, events and results. Paths are any that Spark can open."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import stored

SYSTEM_NUMBERS = ("capacity_kwp", "latitude", "longitude", "tilt_deg", "azimuth_deg", "tariff", "cleaning_cost", "utc_offset_hours")
REQUIRED = ("system_id", "capacity_kwp", "latitude", "longitude")
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("system_id", "date", "type", "note")])


def read_systems(spark: SparkSession, path: str) -> DataFrame:
    """Systems from CSV: numbers where they can be read, the offset from the longitude if blank, places '' if blank. Rows
    without a physical field stop the job; economic_warnings() tells which prices are missing."""
    raw = spark.read.option("header", True).csv(path)
    d = raw.select(F.trim("system_id").alias("system_id"), *[c for c in raw.columns if c not in SYSTEM_NUMBERS and c != "system_id"], *[F.col(c).try_cast("double").alias(c) for c in SYSTEM_NUMBERS if c in raw.columns])
    bad = d.where(F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED]) == 1)
    if names := [r[0] for r in bad.select("system_id").limit(5).collect()]:
        raise ValueError(f"systems without capacity or coordinates, such as {names}")
    offset = F.rint(F.col("longitude") / 15)
    d = d.withColumn("location", F.coalesce("location", F.lit("")) if "location" in d.columns else F.lit(""))
    return d.withColumn("utc_offset_hours", F.coalesce("utc_offset_hours", offset) if "utc_offset_hours" in d.columns else offset)


def economic_warnings(systems: DataFrame) -> DataFrame:
    """system_id, missing: the prices that a system lacks, so that its money can't be told; systems with all of them have no row."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("tariff", "cleaning_cost")]))
    return systems.select("system_id", missing.alias("missing")).where(F.size("missing") > 0)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV: dates, types in lower case (other if blank), notes ('' if blank)."""
    raw = spark.read.option("header", True).schema(EVENT_SCHEMA).csv(path)
    kind = F.lower(F.trim(F.coalesce("type", F.lit("other"))))
    return raw.select(F.trim("system_id").alias("system_id"), F.to_date("date").alias("date"), F.when(kind == "", "other").otherwise(kind).alias("type"), F.coalesce("note", F.lit("")).alias("note"))


def write_by_system(df: DataFrame, path: str) -> None:
    df.write.partitionBy("system_id").parquet(path)


def write_daily(f: DataFrame, path: str) -> None:
    """The daily table by system, numbers at five decimals."""
    doubles = [c for c, t in f.dtypes if t == "double"]
    write_by_system(f.withColumns({c: F.round(c, 5) for c in doubles}), path)


def tidy(c: Column, kind: T.DataType) -> Column:
    """A value with its doubles, nested ones too, at four decimals, and null where they aren't finite."""
    if isinstance(kind, T.DoubleType):
        return F.when(F.abs(F.nanvl(c, F.lit(float("inf")))) < float("inf"), F.round(c, 4))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[tidy(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: tidy(x, kind.elementType))
    return c


def write_summary(rows: DataFrame, path: str) -> None:
    """One JSON object for each row, nested as the row is, finite numbers at four decimals."""
    rows.select(*[tidy(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]).write.json(path)


def _cells(value: Column, width: int) -> Column:
    """A line's values, quoted ones too, as an array of `width` texts; null where they are blank or missing."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(value, ", ".join(f"{n} string" for n in names), {"escape": '"'})  # quotes inside values are doubled
    return F.transform(F.array(parsed), lambda p: F.array(*[p[n] for n in names]))[0]  # so that a line is parsed once


def _header_names(values: Column) -> Column:
    """Column names of a header line: those without a name get one by position, repeated ones a number."""
    trailing = F.array_position(F.transform(F.reverse(values), lambda x: x.isNotNull()), True) - 1  # -1 if all are null
    known = F.slice(values, 1, (F.size(values) - trailing).cast("int"))
    filled = F.transform(known, lambda x, i: F.coalesce(x, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    before = lambda x, i: F.size(F.filter(F.slice(filled, 1, i), lambda y: y == x))
    return F.transform(filled, lambda x, i: F.when(before(x, i) > 0, F.concat(x, F.lit("."), before(x, i).cast("string"))).otherwise(x))


BROADCAST_FILES = 100_000  # headers that are broadcast to the lines of their files at most


def read_export_rows(spark: SparkSession, paths: list[str], name: str = r"([^/]+)$") -> DataFrame:
    """CSV exports, files or folders of them, each file with a header of its own -> file, row_no, cells (column, position, value as text), one row
    a line. The first line of each file that isn't blank is found in one pass; every line is then read under the header
    of its file, so files of any number of layouts go through one plan. Lines equal to their file's header and blank
    lines are no rows; values beyond the header are dropped, missing and blank ones are null; empty files give no rows.
    row_no is (first byte of the part of the file that was read at once, place in that part): it rises with
    the line's place in its file whatever way parts are dealt to tasks. `name` is the pattern whose first group
    takes the file's name from its path."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("path"), place.alias("row_no"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.where(F.trim("value") != "")
    heads = stored(lines.where("row_no.block = 0").groupBy("path").agg(F.min_by("value", "row_no").alias("header")), "headers")
    commas = heads.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))).alias("n"), F.count("*").alias("files")).first()
    width = (commas["n"] or 0) + 1
    heads = heads.select("path", "header", _header_names(_cells(F.col("header"), width)).alias("names"))
    if commas["files"] <= BROADCAST_FILES:
        heads = F.broadcast(heads)
    d = lines.join(heads, "path").where("value <> header").select("path", "row_no", "names", _cells(F.col("value"), width).alias("values"))
    cells = F.transform("names", lambda n, i: F.struct(n.alias("column"), i.alias("position"), F.get("values", i).alias("value")))
    return d.select(F.regexp_extract("path", name, 1).alias("file"), "row_no", cells.alias("cells"))


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV exports, each with its own header -> file, row_no, column, position, value (texts), one row a cell."""
    return read_export_rows(spark, paths).select("file", "row_no", F.explode("cells").alias("c")).select("file", "row_no", "c.*")


def read_day_files(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Day files under system_id=/year=/month=/day=, or under year=/month=/day= where a file holds the day of many systems with
    their ids: only the months of start..end are listed, and of them only the days inside are opened. Months are
    written with or without a leading zero. Empty files give no rows; ids stay texts."""
    day = F.make_date("year", "month", "day")
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    first, last = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (start, end))
    months = ",".join(f"year={m // 12}/month={w}" for m in range(first, last + 1) for w in sorted({f"{m % 12 + 1}", f"{m % 12 + 1:02d}"}))
    days = spark.read.option("header", True).option("basePath", path)
    d = None
    for folder in (path, f"{path}/system_id=*"):
        try:
            d = days.csv(f"{folder}/{{{months}}}/day=*")
            break
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    d = days.csv(path) if d is None else d  # no such month: the filter leaves no row of the columns of other days
    return d.where(inside).withColumn("system_id", F.col("system_id").cast("string")).withColumn("date", day).drop("year", "month", "day")


SITE_SCHEMA = "system_id string, System struct<public_name: string, power: double, started_on: string>, Site struct<latitude: double, longitude: double>, Mount map<string, struct<tilt: double, azimuth: double>>"


def read_site_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a site -> rows of systems: the first mount, the name without its number, the day of the
    start, the offset from the longitude. Prices are the user's and stay null."""
    d = spark.read.schema(SITE_SCHEMA).json(path)
    mount = F.get(F.map_values("Mount"), F.lit(0))
    return d.select(
        "system_id", F.regexp_replace("System.public_name", r"^\[\d+\]\s*", "").alias("name"), F.col("System.power").alias("capacity_kwp"), F.col("Site.latitude").alias("latitude"), F.col("Site.longitude").alias("longitude"),
        mount["tilt"].alias("tilt_deg"), mount["azimuth"].alias("azimuth_deg"), F.substring("System.started_on", 1, 10).alias("commissioning_date"), F.rint(F.col("Site.longitude") / 15).alias("utc_offset_hours"),
    )


WEATHER_SCHEMA = "system_id string, header struct<fill_value: double>, properties struct<parameter: map<string, map<string, double>>>"
#: Names in the payload and in the frame. Fixed values of the format.
WEATHER_NAMES = {"ALLSKY_SFC_SW_DWN": "ghi", "CLRSKY_SFC_SW_DWN": "clear_ghi", "T2M": "t2m_c", "PRECTOTCORR": "precip_mm"}


def read_weather(spark: SparkSession, path: str, hourly: bool = False, fill: float = -999.0) -> DataFrame:
    """Weather payloads, one JSON object a line, any number of them -> system_id, date (or hour_utc) and the
    four values. The fill value of the header counts before the default; filled values are null."""
    d = spark.read.schema(WEATHER_SCHEMA).json(path)
    d = d.select("system_id", F.coalesce("header.fill_value", F.lit(fill)).alias("_f"), F.explode("properties.parameter").alias("name", "values"))
    d = d.select("system_id", "_f", "name", F.explode("values").alias("k", "v"))
    when = F.to_timestamp_ntz("k", F.lit("yyyyMMddHH")).alias("hour_utc") if hourly else F.to_date("k", "yyyyMMdd").alias("date")
    known = F.when(F.abs(F.col("v") - F.col("_f")) > 1e-8 + 1e-5 * F.abs("_f"), F.col("v"))
    d = d.select("system_id", when, "name", known.alias("v"))
    keys = ["system_id", "hour_utc" if hourly else "date"]
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(n) for k, n in WEATHER_NAMES.items()])


def tidy_month_sheet(sheet: DataFrame, year: int | Column, month: str, day: str, total: str, keys=()) -> DataFrame:
    """Titled sheets read as texts -> keys, date, energy_kwh: rows whose month and day are numbers."""
    m, n = F.col(month).try_cast("double").cast("int"), F.col(day).try_cast("double").cast("int")
    return sheet.where(m.isNotNull() & n.isNotNull()).select(*keys, F.make_date(F.lit(year), m, n).alias("date"), F.col(total).try_cast("double").alias("energy_kwh"))
