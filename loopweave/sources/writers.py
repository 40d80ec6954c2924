"""Writers. A path is a URI: its scheme chooses the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.dimensions import dense_ids
from loopweave.sources import published
from loopweave.sources.readers import profile_text_lines


def write_profiles(profiles: DataFrame, path: str, measures: list[str], fmt: str = "parquet",
                   compression: str | None = None) -> str:
    """Station-day profiles: Parquet by year (the default) or ``[...]`` text lines."""
    if fmt == "parquet":
        # Ranges of (year, station, day): few files per year, narrow station ranges
        # per file for pruning, and no range holds one hot station whole.
        order = ["year", "station_id", "day_of_year"]
        profiles.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(
            "year").parquet(path)
    else:
        lines = profile_text_lines(profiles, measures)
        lines.write.option("compression", compression or "bzip2").text(path)
    return path


def write_lines(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("sep", sep).csv(path)
    return path


def named_path(folder: str, token: str, fid: str, prefix: str = "total_flow") -> str:
    return f"{folder.rstrip('/')}/{prefix}_{token}.{fid}.csv"


def write_vectors(df: DataFrame, vector: str, width: int, path: str, quote: bool = True,
                  order: list[str] | None = None) -> str:
    """One line of ``width`` numbers per vector, quoted, without a header.

    With ``order``, the files in the order of their names hold the vectors in
    that order, which ``read_matrix_csv`` turns into row numbers again.
    """
    cells = [F.col(vector)[i].cast("string").alias(f"c{i}") for i in range(width)]
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(*cells).write.option("quoteAll", str(quote).lower()).csv(path)
    return path


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 200_000, truncate: bool = False,
               properties: dict[str, str] | None = None) -> None:
    """Append to a database table in batches, or empty it first. Needs a reachable database."""
    options = {**(properties or {}), "batchsize": str(batch)}
    if truncate:
        options["truncate"] = "true"
    df.write.jdbc(url, table, mode="overwrite" if truncate else "append", properties=options)


def replace_table(df: DataFrame, root: str, name: str = "table",
                  audits: list[published.Audit] | None = None) -> published.Version:
    """Load a table in place of what it held; a load that fails leaves that as it was."""
    return published.load(df.sparkSession, root, {name: df}, {name: audits or []})


def write_json_records(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def marker_pages(df: DataFrame, keys: list[str], per_page: int = 1000) -> DataFrame:
    """(page, n, markers): JSON arrays of at most ``per_page`` records each.

    Pages follow dense ids of the unique ``keys``, so every array is bounded.
    """
    numbered = dense_ids(df, keys, "_id")
    record = F.struct(*df.columns)
    return (numbered.groupBy(F.floor((F.col("_id") - 1) / per_page).alias("page"))
            .agg(F.count("*").alias("n"), F.to_json(F.collect_list(record)).alias("markers")))


def write_csv(df: DataFrame, path: str, header: bool = True, quote: bool = False) -> str:
    (df.write.option("header", str(header).lower()).option("quoteAll", str(quote).lower())
     .csv(path))
    return path


def discard(df: DataFrame) -> None:
    """Run the whole plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_statistics(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path
