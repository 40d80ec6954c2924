"""Readers for the raw feeds and for the tables and files that other jobs write.

Every path argument may be one path, a list of paths, a folder or a glob on any
store Spark can reach; compression follows the file extension.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopweave.functions import calendar, scalars
from loopweave.operators.dimensions import ordered_ids
from loopweave.schemas import (INCIDENTS, PROFILE_KEYS, STATION_META, STATION_TYPE_LOOKUP,
                               ZIP_DENSITY, wide_columns)
from loopweave.sources.stores import known, store

Paths = str | list[str]

# Leading fields of a raw sensor line, and the group repeated per lane.
STATION_FIELDS = [
    ("time", "timestamp"), ("station", "long"), ("district", "int"), ("freeway", "int"),
    ("direction", "string"), ("lane_type", "string"), ("length", "double"), ("samples", "int"),
    ("pct_observed", "double"), ("total_flow", "double"), ("avg_occupancy", "double"),
    ("avg_speed", "double")]
LANE_FIELDS = [("samples", "int"), ("flow", "int"), ("occupancy", "double"), ("speed", "double"),
               ("observed", "int")]


def read_lines(spark: SparkSession, paths: Paths, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)


def _split_lines(lines: DataFrame) -> DataFrame:
    """The comma-separated parts of every line, as ``_p``.

    The one-element explode keeps later filters above the split; pushed below
    it, each of them would split the line again.
    """
    return lines.select(F.explode(F.array(F.split("value", ","))).alias("_p"))


def _field(name: str, kind: str, text: Column, blank_zero: bool) -> Column:
    if kind == "timestamp":
        return calendar.feed_time(text).alias(name)
    if kind == "string":
        return text.alias(name)
    return (scalars.blank_as_zero(text) if blank_zero else text).try_cast(kind).alias(name)


def read_station_5min(spark: SparkSession, paths: Paths, blank_zero: bool = False) -> DataFrame:
    """Headerless sensor lines: the twelve station fields, and ``bad_reading``.

    A field that does not parse is null; ``bad_reading`` marks lines whose time,
    station or one of the three measures is missing.
    """
    parts = _split_lines(read_lines(spark, paths))
    rows = parts.select(*[_field(n, k, F.get("_p", F.lit(i)), blank_zero)
                          for i, (n, k) in enumerate(STATION_FIELDS)])
    needed = ["time", "station", "total_flow", "avg_occupancy", "avg_speed"]
    bad = F.lit(False)
    for name in needed:
        bad = bad | F.col(name).isNull()
    return rows.withColumn("bad_reading", bad)


def read_station_feed(spark: SparkSession, paths: Paths) -> DataFrame:
    """Whole sensor lines: the station fields, ``observation_id`` and the raw lane texts.

    The id packs station and epoch second, the natural key of a reading: it needs
    no counter, so it is the same on every attempt. Blank fields are 0.
    """
    parts = _split_lines(read_lines(spark, paths))
    fields = [_field(n, k, F.get("_p", F.lit(i)), True)
              for i, (n, k) in enumerate(STATION_FIELDS)]
    lanes = F.slice("_p", len(STATION_FIELDS) + 1, F.greatest(
        F.size("_p") - len(STATION_FIELDS), F.lit(0)))
    return parts.select(*fields, lanes.alias("lane_texts")).withColumn(
        "observation_id", F.shiftleft(F.col("station"), 33) + calendar.wall_seconds(F.col("time")))


def station_part(lines: DataFrame) -> DataFrame:
    return lines.select("observation_id", "station", "district", "freeway", "direction",
                        "lane_type", "length")


def observation_part(lines: DataFrame) -> DataFrame:
    return lines.select("observation_id", "time", "station", "samples", "pct_observed",
                        "total_flow", "avg_occupancy", "avg_speed")


def lane_part(lines: DataFrame) -> DataFrame:
    """One row per complete lane group; lanes count from 0."""
    width = len(LANE_FIELDS)
    lanes = F.floor(F.size("lane_texts") / width).cast("int")
    exploded = lines.select("observation_id", "station", "lane_texts", F.explode(
        F.when(lanes > 0, F.sequence(F.lit(0), lanes - 1))).alias("lane"))
    return exploded.select("observation_id", "station", "lane", *[
        _field(n, k, F.get("lane_texts", F.lit(i) + F.col("lane") * width), True)
        for i, (n, k) in enumerate(LANE_FIELDS)])


def split_station_feed(spark: SparkSession, paths: Paths) -> dict[str, DataFrame]:
    """Station, observation and lane parts of the raw feed under one observation id."""
    lines = read_station_feed(spark, paths)
    return {"station": station_part(lines), "observation": observation_part(lines),
            "lane": lane_part(lines)}


def read_station_meta(spark: SparkSession, paths: Paths) -> DataFrame:
    """Tab-separated station metadata; the effective date comes from the file path."""
    rows = (spark.read.option("sep", "\t").option("header", "true").schema(STATION_META)
            .csv(paths))
    return rows.withColumn("eff_start", scalars.date_in_path(F.col("_metadata.file_path")))


def read_incidents(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.schema(INCIDENTS).csv(paths)


# Field widths of an hourly precipitation record; the rest holds the values.
PRECIPITATION_FIELDS = [
    ("record_type", 3), ("state_code", 2), ("station_number", 4), ("division", 2),
    ("element_type", 4), ("element_units", 2), ("year", 4), ("month", 2), ("day", 4),
    ("value_count", 3)]


def read_hourly_precipitation(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """(records, refused lines) of a folder tree of fixed-width files."""
    lines = read_lines(spark, paths, recursive=True)
    head = sum(width for _, width in PRECIPITATION_FIELDS)
    columns, start = [], 1
    for name, width in PRECIPITATION_FIELDS:
        columns.append(F.substring("value", start, width).alias(name))
        start += width
    long_enough = F.length("value") >= head
    records = lines.filter(long_enough).select(
        *columns, F.substring(F.col("value"), F.lit(head + 1), F.length("value")).alias("values"))
    refused = lines.filter(~long_enough).select(
        "value", F.col("_metadata.file_path").alias("file"), F.lit("line too short").alias("message"))
    return records, refused


# Slices of a weather-station line (start, end exclusive).
WEATHER_STATION_FIELDS = [
    ("STNIDNUM", 0, 8), ("RECTYPE", 9, 11), ("COOPID", 12, 18), ("CLIMDIV", 19, 21),
    ("WBANID", 22, 27), ("WMOID", 28, 33), ("FAAID", 34, 38), ("NWSID", 39, 44),
    ("ICAOID", 45, 49), ("COUNTRYNAME", 50, 69), ("STATEPROV", 71, 73), ("COUNTY", 74, 104),
    ("TIME_ZONE", 105, 110), ("COOPNAME", 111, 141), ("WBANNAME", 142, 172),
    ("BEGINDATE", 173, 181), ("ENDDATE", 182, 190), ("LATDIR", 191, 192), ("LAT_D", 192, 194),
    ("LAT_M", 195, 197), ("LAT_S", 198, 200), ("LONDIR", 201, 202), ("LON_D", 202, 205),
    ("LON_M", 206, 208), ("LON_S", 209, 211), ("LATLONPREC", 212, 214), ("EL_GROUND", 215, 221),
    ("EL_OTHER", 222, 228), ("ELEVOTHERTYPE", 229, 231), ("RELOC", 232, 243),
    ("STNTYPE", 244, 294)]
WEATHER_STATION_NUMBERS = {"LAT_D", "LAT_M", "LAT_S", "LON_D", "LON_M", "LON_S", "LATLONPREC",
                           "EL_GROUND", "EL_OTHER", "ELEVOTHERTYPE"}


def read_weather_stations(spark: SparkSession, paths: Paths, state: str = "04") -> DataFrame:
    """Fixed-width station list of one state; blank fields are null."""
    columns = []
    for name, start, end in WEATHER_STATION_FIELDS:
        text = F.nullif(F.trim(F.substring("value", start + 1, end - start)), F.lit(""))
        columns.append((text.try_cast("long") if name in WEATHER_STATION_NUMBERS else text)
                       .alias(name))
    rows = read_lines(spark, paths).select(*columns)
    return rows.filter(F.col("COOPID").startswith(state))


def weather_station_table(raw: DataFrame) -> DataFrame:
    """Id, name and decimal position of the fixed-width station list."""
    def angle(prefix):
        return scalars.decimal_degrees(F.col(f"{prefix}_D"), F.col(f"{prefix}_M"),
                                       F.col(f"{prefix}_S"), F.col(f"{prefix}DIR"))

    return raw.select(scalars.id_without_prefix(F.col("COOPID")).alias("id"),
                      F.col("COOPNAME").alias("name"), angle("LAT").alias("latitude"),
                      angle("LON").alias("longitude"),
                      F.col("EL_GROUND").cast("double").alias("elevation"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 32,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A database table, read in parallel ranges when a numeric column is named."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0],
                           upperBound=bounds[1], numPartitions=partitions,
                           properties=properties or {})


def read_lookup(spark: SparkSession, paths: Paths,
                schema: T.StructType = STATION_TYPE_LOOKUP) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(paths)


def read_pivot_parquet(spark: SparkSession, paths: Paths, view: str | None = None) -> DataFrame:
    """Station-day profiles with the direction as a double and as a 0/1 vector.

    The vector has a place for codes 0..3, so code 4 is all zeros.
    """
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    code = F.col("direction").cast("double")
    rows = rows.withColumn("direction", code).withColumn("direction_vector", F.array(*[
        F.when(code == float(i), 1.0).otherwise(0.0) for i in range(4)]))
    if view:
        rows.createOrReplaceTempView(view)
    return rows


def read_pivot_text(spark: SparkSession, paths: Paths, measures: list[str],
                    slots: int = 288) -> DataFrame:
    """Lines ``[key,...,value,...]``: six integer keys, then all slots of each measure.

    A line that does not parse fails the read.
    """
    count = len(PROFILE_KEYS) + len(measures) * slots
    parts = F.split(F.regexp_replace("value", r"^\[|\]$", ""), ",")
    rows = read_lines(spark, paths).select(parts.alias("_p"))
    exact = F.when(F.size("_p") == count, F.col("_p")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {count} fields, found "),
                               F.size("_p").cast("string"))))
    rows = rows.select(exact.alias("_p"))
    keys = [F.get("_p", F.lit(i)).cast("int").alias(k) for i, k in enumerate(PROFILE_KEYS)]
    arrays = [F.transform(F.slice("_p", len(PROFILE_KEYS) + 1 + m * slots, slots),
                          lambda x: x.cast("double")).alias(name)
              for m, name in enumerate(measures)]
    return rows.select(*keys, *arrays)


def read_numeric_csv(spark: SparkSession, paths: Paths) -> DataFrame:
    """CSV of doubles under a header; lines with anything else are dropped."""
    text = spark.read.option("header", "true").csv(paths)
    return text.select(*[F.col(f"`{c}`").try_cast("double").alias(c)
                         for c in text.columns]).dropna(how="any")


def read_matrix_csv(spark: SparkSession, paths: Paths, width: int) -> DataFrame:
    """Headerless quoted CSV of ``width`` doubles per line as (row, values).

    Rows count from 0 in the order of file names, then lines, however Spark
    packs the files into tasks.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(width)])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").csv(paths)
    placed = rows.select(F.array(*schema.names).alias("values"),
                         F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_line"))
    numbered = ordered_ids(placed, ["_file", "_start", "_line"], "row")
    return numbered.select((F.col("row") - 1).alias("row"), "values")


def read_json_records(spark: SparkSession, paths: Paths, schema: T.StructType | str,
                      multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(paths)


def read_object(spark: SparkSession, store: str, key: str, fmt: str = "text",
                schema: T.StructType | str | None = None) -> DataFrame:
    """An object by store URI and key; credentials belong to the cluster configuration."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(f"{store.rstrip('/')}/{key}")


def _stream(uri: str):
    """Open a file of a known store, or a plain path, for sequential reading."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    files, path = store(uri)
    return files.open_input_stream(path, compression=None)


def _archive_lines(batches: Iterator[pa.RecordBatch], size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Stream the lines of all files inside the archives; no archive is held in memory."""
    def batch(members, lines):
        return pa.RecordBatch.from_arrays([pa.array(members, pa.string()),
                                           pa.array(lines, pa.string())], ["member", "line"])

    members, lines = [], []
    for paths in batches:
        for i, uri in enumerate(paths.column(0).to_pylist()):
            source = (io.BytesIO(paths.column(1)[i].as_py()) if paths.num_columns > 1
                      else _stream(uri))
            with source as raw, tarfile.open(fileobj=raw, mode="r|gz") as archive:
                for member in archive:
                    if not member.isfile():
                        continue
                    for line in archive.extractfile(member):
                        members.append(member.name)
                        lines.append(line.decode("utf-8").rstrip("\r\n"))
                        if len(lines) >= size:
                            yield batch(members, lines)
                            members, lines = [], []
    if lines:
        yield batch(members, lines)


def read_tar_gz(spark: SparkSession, paths: Paths) -> DataFrame:
    """(member, line) of all files inside tar.gz archives.

    Archives cannot be split, so one task streams one archive. Where only Spark
    can open the store, it hands the tasks the archives' bytes (up to 2 GB each).
    """
    files = spark.read.format("binaryFile").load(paths)
    direct = all(known(p) for p in ([paths] if isinstance(paths, str) else paths))
    return files.select("path", *([] if direct else ["content"])).mapInArrow(
        _archive_lines, "member string, line string")


def read_home_values(spark: SparkSession, paths: Paths) -> DataFrame:
    """One wide row per ZIP with a text column per month."""
    return spark.read.option("header", "true").csv(paths)


def read_zip_density(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.option("header", "true").schema(ZIP_DENSITY).csv(paths)


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    return spark.sql(text, args=args or {})


def row_batches(df: DataFrame, map_row: Callable | None = None, size: int = 500,
                after: Callable[[int], None] | None = None) -> Iterable[list]:
    """Mapped rows in batches, one partition at a time; ``after`` gets the row count."""
    batch, seen = [], 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(map_row(row) if map_row else row)
        seen += 1
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
    if after:
        after(seen)


def count_lines_with(spark: SparkSession, paths: Paths, words: list[str]) -> DataFrame:
    """(word, n): lines that contain each word, in one pass."""
    counts = read_lines(spark, paths).agg(*[
        F.count_if(F.col("value").contains(w)).alias(f"_{i}") for i, w in enumerate(words)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"_{i}").alias("n"))
                      for i, w in enumerate(words)])
    return counts.select(F.inline(pairs))


# Fixed pattern: a quoted CSV field, in which a backslash escapes.
QUOTED_FIELD = r'"(?:[^"\\]|\\.)*"'


def read_controlled(spark: SparkSession, paths: Paths,
                    schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed rows, errors) of a headerless CSV.

    Errors name the file, the line, the field and its text, one row per bad
    field; a line with too few or too many fields gives one error without a field.
    Fields are counted with quoted text left out.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    count = len(schema.fields)
    # One extra column catches surplus fields.
    probe = T.StructType(texts.fields + [T.StructField("_extra", T.StringType())])
    lines = read_lines(spark, paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.from_csv("value", probe.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"}
                   ).alias("_t"))

    def text(name):
        return F.nullif(F.col(f"_t.{name}"), F.lit(""))

    wrong = [F.when(text(f.name).isNotNull()
                    & text(f.name).try_cast(f.dataType.simpleString()).isNull(),
                    F.struct(F.lit(f.name).alias("field"), text(f.name).alias("text"),
                             F.lit(f"not a {f.dataType.simpleString()}").alias("message")))
             for f in schema.fields]
    unquoted = F.regexp_replace("value", QUOTED_FIELD, "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    short = F.when(commas != count - 1, F.struct(
        F.lit(None).cast("string").alias("field"), F.col("value").alias("text"),
        F.lit(f"expected {count} fields").alias("message")))
    checked = lines.withColumn("_errors", F.array_compact(F.array(short, *wrong)))
    rows = checked.filter(F.size("_errors") == 0).select(*[
        text(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in schema.fields])
    errors = (checked.select("file", F.col("value").alias("record"),
                             F.explode("_errors").alias("_e"))
              .select("file", "record", "_e.field", "_e.text", "_e.message"))
    return rows, errors


def profile_text_lines(profiles: DataFrame, measures: list[str]) -> DataFrame:
    """Profiles as ``[key,...,value,...]`` lines."""
    cells = F.concat(*[F.transform(m, lambda x: x.cast("string")) for m in measures])
    keys = F.array(*[F.col(k).cast("string") for k in PROFILE_KEYS])
    return profiles.select(F.concat(F.lit("["), F.array_join(F.concat(keys, cells), ","),
                                    F.lit("]")).alias("value"))


def wide_to_arrays(wide: DataFrame, measures: list[str], slots: int = 288) -> DataFrame:
    keys = [c for c in PROFILE_KEYS if c in wide.columns]
    return wide.select(*keys, *[F.array(*wide_columns(m, slots)).alias(m) for m in measures])
