"""Sinks (K): written to a new folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.reading import MEASURES, coefficient_rows
from loopweave.catalog.registry import query
from loopweave.operators import aggregates, dimensions
from loopweave.schemas import fields
from loopweave.session import scratch_path
from loopweave.sources import published, readers, writers


@query("k01_profiles_bzip2", """
    select vec_id::int as station_id, i::int as slot, embedding[i + 1]::double as flow,
      embedding[64 - i]::double as occupancy from embeddings, range(64) r(i)""")
def k01(t):
    path = writers.write_profiles(coefficient_rows(t), scratch_path(t.spark, "bzip2"), MEASURES,
                                  fmt="text", compression="bzip2")
    rows = readers.read_pivot_text(t.spark, f"{path}/*.bz2", MEASURES, slots=64)
    cells = F.posexplode(F.arrays_zip("total_flow", "occupancy")).alias("slot", "v")
    return rows.select("station_id", cells).select(
        "station_id", "slot", F.col("v.total_flow").alias("flow"), "v.occupancy")


@query("k02_csv_lines", """select id, station_id, total_flow from observation""")
def k02(t):
    rows = t.observation.select("id", "station_id", "total_flow")
    path = writers.write_lines(rows, scratch_path(t.spark, "lines"))
    return t.spark.read.schema(fields("id long, station_id long, total_flow double")).csv(path)


@query("k03_named_vector_files", """
    with x as (select unnest(embedding)::double as v, unnest(range(64))::int as slot
               from embeddings)
    select slot, round(avg(v), 8) + 0.0::double as mean from x group by 1""")
def k03(t):
    means = aggregates.vector_moments(t.embeddings, "embedding")
    path = writers.named_path(scratch_path(t.spark, "vectors"), "mean_vector", "pivot_2008")
    writers.write_vectors(means, "mean", 64, path)
    rows = readers.read_matrix_csv(t.spark, path, 64)
    return rows.select(F.posexplode("values").alias("slot", "v")).select(
        "slot", F.round("v", 8).alias("mean"))


@query("k06_truncate_and_load", """select n_nationkey as id, n_name as name from nation""")
def k06(t):
    path = scratch_path(t.spark, "replaced")
    writers.replace_table(t.region.select(F.col("r_regionkey").alias("id"),
                                          F.col("r_name").alias("name")), path)
    writers.replace_table(t.nation.select(F.col("n_nationkey").alias("id"),
                                          F.col("n_name").alias("name")), path)
    return published.read(t.spark, path, "table")


@query("k07_json_records", """select id, latitude, longitude, description from incident""")
def k07(t):
    rows = t.incident.select("id", "latitude", "longitude", "description")
    path = writers.write_json_records(rows, scratch_path(t.spark, "json"))
    return t.spark.read.schema("id long, latitude double, longitude double, description string"
                               ).json(path)


@query("k07_marker_pages", """
    select (id - 1) // 1000 as page, count(*) as n, sum(length(name))::bigint as chars
    from (select name, row_number() over (order by substr(md5(id::varchar), 1, 3), id) as id
          from current_station) group by 1""")
def k07_pages(t):
    pages = writers.marker_pages(t.current_station.select("id", "name"), ["id"], 1000)
    records = F.from_json("markers", "array<struct<id:bigint,name:string>>")
    return pages.select("page", "n", F.aggregate(
        records, F.lit(0).cast("bigint"), lambda acc, r: acc + F.length(r["name"])).alias("chars"))


@query("k08_quoted_csv", """
    select c_custkey as station, c_name as name, c_acctbal as density from customer""")
def k08(t):
    rows = t.customer.select(F.col("c_custkey").alias("station"), F.col("c_name").alias("name"),
                             F.col("c_acctbal").alias("density"))
    path = writers.write_csv(rows, scratch_path(t.spark, "quoted"), header=True, quote=True)
    return (t.spark.read.option("header", "true")
            .schema("station long, name string, density double").csv(path))


@query("k09_update_and_overwrite", """
    select c.id, coalesce(p.p_size % 2, 0)::int as urban, p.p_retailprice as density
    from current_station c left join part p on p.p_partkey = c.id * 2""")
def k09(t):
    stations = t.current_station.select("id", F.lit(0).alias("urban"),
                                        F.lit(None).cast("double").alias("density"))
    root = scratch_path(t.spark, "stations")
    writers.replace_table(stations, root)
    changes = t.part.select((F.col("p_partkey") / 2).alias("half"), "p_partkey",
                            (F.col("p_size") % 2).alias("urban"), "p_retailprice")
    changes = changes.filter(F.col("p_partkey") % 2 == 0).withColumn(
        "id", F.col("half").cast("long"))
    updated = dimensions.update_by_key(published.read(t.spark, root, "table"), changes, {"id": "id"},
                                       {"urban": "urban", "p_retailprice": "density"},
                                       {"urban": 0})
    # The load reads the table that it replaces: its version stays until the new one is whole.
    writers.replace_table(updated, root, audits=[published.unique("id")])
    return published.read(t.spark, root, "table").select("id", "urban", "density")


@query("k10_discard", """select count(*) as n from lane_observation""")
def k10(t):
    writers.discard(t.lane_observation)
    return t.lane_observation.agg(F.count("*").alias("n"))


@query("k11_temp_view", """
    select lane_type, count(*) as n from observation group by lane_type""")
def k11(t):
    writers.register_view(t.observation, "k11_observation")
    return t.spark.sql("select lane_type, count(*) as n from k11_observation group by lane_type")


@query("k12_persisted_statistics", """
    with x as (select label, unnest(embedding)::double as v, unnest(range(64))::int as slot
               from embeddings)
    select label, slot, round(stddev_samp(v), 8) as std from x group by 1, 2""")
def k12(t):
    path = writers.write_statistics(
        aggregates.vector_moments(t.embeddings, "embedding", ["label"]),
        scratch_path(t.spark, "statistics"))
    rows = aggregates.per_slot(t.spark.read.parquet(path), ["label"])
    return rows.select("label", "slot", F.round("std", 8).alias("std"))
