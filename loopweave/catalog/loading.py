"""Loads that add to what is stored: incremental dimensions, changed files, failed loads."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loopweave.catalog.registry import query
from loopweave.operators import dimensions, history
from loopweave.session import remove, scratch_path
from loopweave.sources import published, writers
from loopweave.streaming import enrichment, feeds, ledger

#: The versions of the station feed in two snapshots: those that start up to 1995, and all.
FIRST = "eff_start < date '1996-01-01'"

GROWN_SQL = f"""grown as (
    with u as (select * from (select *, row_number() over (partition by sensor_id, eff_start
               order by num_lanes) as rn from station_versions) where rn = 1),
    a as (select *, row_number() over (order by sensor_id, eff_start) as id from u where {FIRST}),
    b as (select *, (select count(*) from a) + row_number() over (order by sensor_id, eff_start)
            as id from u where not ({FIRST}))
    select *, lead(eff_start) over (partition by sensor_id order by eff_start) as eff_end
    from (select *, true as first from a union all select *, false from b)),
    early as (select *, lead(eff_start) over (partition by sensor_id order by eff_start)
                as early_end from grown where first)"""


def grown_history(t):
    """(folder, history after the first snapshot, after both) of a published history."""
    root = scratch_path(t.spark, "star")
    how = {"tie_break": ["num_lanes"]}
    first = history.merge_history(t.spark, root, t.station_versions.filter(FIRST), **how)
    both = history.merge_history(t.spark, root, t.station_versions, **how)
    return root, *(published.read(t.spark, root, "traffic_station", at=v) for v in (first, both))


@query("n12_incremental_history", f"""
    with {GROWN_SQL} select id, sensor_id, eff_start, eff_end, name, fwy_id, num_lanes from grown""")
def n12_incremental(t):
    """Two snapshots: the intervals of both together, the ids of the first unchanged."""
    return grown_history(t)[2].select("id", "sensor_id", "eff_start", "eff_end", "name", "fwy_id",
                                      "num_lanes")


@query("w05_ids_kept_over_loads", f"""
    with {GROWN_SQL}
    select e.id, e.sensor_id, e.eff_start, e.early_end, g.eff_end
    from early e join grown g using (id) where e.early_end is distinct from g.eff_end""")
def w05_kept(t):
    """Versions whose end the second load changed, found by their unchanged ids."""
    _, before, after = grown_history(t)
    ends = history.moved(before, after)
    return after.join(ends, "id").select("id", "sensor_id", "eff_start",
                                         F.col("old_end").alias("early_end"), "eff_end")


@query("j05_stored_versions_after_a_load", f"""
    with {GROWN_SQL},
    days as (select id, station_id, cast(time as date) - 10250 as day from observation)
    select d.id, d.station_id, coalesce(e.id, -1) as stored, coalesce(g.id, -1) as station_version,
      coalesce(e.id, -1) <> coalesce(g.id, -1) as moves
    from days d left join early e on e.sensor_id = d.station_id and e.eff_start <= d.day
      and (e.early_end is null or d.day < e.early_end)
    left join grown g on g.sensor_id = d.station_id and g.eff_start <= d.day
      and (g.eff_end is null or d.day < g.eff_end)""")
def j05_stored(t):
    """Facts stored against the first history, and what the second one says of them."""
    _, before, after = grown_history(t)
    facts = t.observation.select("id", "station_id", F.date_sub("time", 10250).alias("day"))
    stored = dimensions.version_at(facts, before, "station_id", "day", "sensor_id", out="stored")
    now = dimensions.version_at(stored, after, "station_id", "day", "sensor_id")
    return now.select("id", "station_id", "stored", "station_version",
                      (F.col("stored") != F.col("station_version")).alias("moves"))


@query("j05_facts_to_move", f"""
    with {GROWN_SQL},
    days as (select id, station_id, cast(time as date) - 10250 as day from observation)
    select d.id, e.id as station_version
    from days d join early e on e.sensor_id = d.station_id and e.eff_start <= d.day
      and (e.early_end is null or d.day < e.early_end)
    join grown g on g.id = e.id where d.day >= g.eff_end""")
def j05_facts_to_move(t):
    """Stored facts that the second load takes from their version."""
    _, before, after = grown_history(t)
    facts = t.observation.select("id", "station_id", F.date_sub("time", 10250).alias("day"))
    stored = dimensions.version_at(facts, before, "station_id", "day", "sensor_id")
    found = history.facts_to_move(stored, history.moved(before, after), "day")
    return found.select("id", "station_version")


@query("n12_dimension_ids_over_loads", """
    with keys as (select sensor_id % 7 as county, sensor_id % 5 as city, min(year(eff_start)) as y
                  from station_versions group by all),
    years as (select county, city, case when y < 1993 then 1 when y < 1995 then 2 else 3 end as load
              from keys)
    select load, county, city, row_number() over (order by load, county, city) as id from years""")
def n12_dimension_ids(t):
    """A dimension in three loads, by year: each new key gets the next id."""
    root, stored, out = scratch_path(t.spark, "star"), None, None
    year = F.year("eff_start")
    for number, part in enumerate((year < 1993, (year >= 1993) & (year < 1995), year >= 1995), 1):
        rows = t.station_versions.filter(part).select(
            (F.col("sensor_id") % 7).alias("county"), (F.col("sensor_id") % 5).alias("city"),
            F.lit(number).alias("load"))
        stored = history.merged_dimension(t.spark, root, stored, rows, ["county", "city"], ["load"])
    return published.table(t.spark, stored).select("load", "county", "city", "id")


@query("k06_failed_loads_keep_rows", """
    select 'first load' as after, r_regionkey as id, r_name as name from region
    union all select 'failed job', r_regionkey, r_name from region
    union all select 'failed audit', r_regionkey, r_name from region
    union all select 'second load', n_nationkey, n_name from nation""")
def k06_failed(t):
    """What readers see after a load, one whose job fails, one that an audit refuses, and a load."""
    root = scratch_path(t.spark, "names")
    regions = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nations = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    last = nations.agg(F.max("id")).first()[0]
    breaks = nations.withColumn("id", F.when(F.col("id") == last, F.raise_error(
        F.lit("a bad row")).cast("int")).otherwise(F.col("id")))
    twice = nations.unionByName(nations)
    seen = []
    for after, rows in (("first load", regions), ("failed job", breaks), ("failed audit", twice),
                        ("second load", nations)):
        try:
            writers.replace_table(rows, root, audits=[published.not_empty, published.unique("id")])
        except (PySparkException, published.AuditFailed):
            if not after.startswith("failed"):
                raise
        seen.append(published.read(t.spark, root, "table").select(F.lit(after).alias("after"), "*"))
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


READING = "id long, time timestamp_ntz, station_id long, total_flow double"


def _feed_files(t, folder, rows):
    rows.select("id", "time", "station_id", "total_flow").write.csv(folder)


def _rewrite(spark, folder, change):
    """Give every file of a folder other rows, under its old name."""
    fs = spark._jvm.org.apache.hadoop.fs
    for (name,) in ledger.listing(spark, folder).select("name").collect():
        aside = scratch_path(spark, "rewritten")
        change(spark.read.schema(READING).csv(name)).coalesce(1).write.csv(aside)
        made = ledger.listing(spark, aside).first()[0]
        old, new = fs.Path(name), fs.Path(made)
        files = old.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(old, False)
        files.rename(new, old)


@query("x01_changed_files", """
    select id, station_id, total_flow * case when extract(day from time) > 20 then 1 else 2 end
      as total_flow from observation where extract(day from time) > 10""")
def x01_changed(t):
    """Three runs over a feed folder: files come, files are rewritten and come, files go."""
    folder, root = scratch_path(t.spark, "feed"), scratch_path(t.spark, "star")
    day, files = F.dayofmonth("time"), t.spark
    remove_later, rewritten = f"{folder}/a", f"{folder}/b"

    def read(spark, names):
        return spark.read.schema(READING).csv(names) if names else spark.createDataFrame([], READING)

    _feed_files(t, remove_later, t.observation.filter(day <= 10))
    _feed_files(t, rewritten, t.observation.filter((day > 10) & (day <= 20)))
    ledger.follow(t.spark, folder, root, read)
    _rewrite(files, rewritten, lambda rows: rows.withColumn("total_flow", F.col("total_flow") * 2))
    _feed_files(t, f"{folder}/c", t.observation.filter(day > 20))
    ledger.follow(t.spark, folder, root, read)
    remove(t.spark, remove_later)
    ledger.follow(t.spark, folder, root, read)
    return ledger.rows(t.spark, root).select("id", "station_id", "total_flow")


@query("x04_changing_history", """
    select o.id, o.station_id, coalesce(s.id, -1) as station_version
    from (select id, station_id, cast(time as date) - 8760 as day from observation) o
    left join traffic_station s on s.sensor_id = o.station_id and s.eff_start <= o.day
      and (s.eff_end is null or o.day < s.eff_end)""")
def x04_changing(t):
    """Readings and versions arrive in turn, newest versions first; the last answers hold."""
    spark = t.spark
    asked, told = scratch_path(spark, "readings"), scratch_path(spark, "versions")
    out, checkpoint = scratch_path(spark, "enriched"), scratch_path(spark, "checkpoint")
    rows = t.observation.select("id", "station_id", (F.col("time") - F.expr(
        "interval '8760' day")).alias("time"))
    versions = t.traffic_station.select("id", "sensor_id", "eff_start")
    day, cut = F.dayofmonth("time"), F.to_date(F.lit("1999-01-01"))
    turns = [(day <= 10, F.col("eff_start") >= cut), ((day > 10) & (day <= 20), None),
             (day > 20, F.col("eff_start") < cut)]
    before = spark.conf.get(enrichment.STATE_STORE)
    spark.conf.set(enrichment.STATE_STORE, enrichment.ROCKS_DB)
    try:
        for readings, known in turns:
            rows.filter(readings).write.mode("append").parquet(asked)
            versions.filter(known if known is not None else F.lit(False)).write.mode(
                "append").parquet(told)
            stream = enrichment.with_changing_history(
                feeds.arriving_files(spark, asked, rows.schema),
                feeds.arriving_files(spark, told, versions.schema))
            feeds.drain_updates(stream, out, checkpoint)
    finally:
        spark.conf.set(enrichment.STATE_STORE, before)
    return feeds.latest_updates(spark, out, ["id"]).select("id", "station_id", "station_version")
