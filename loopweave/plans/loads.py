"""Loads of the star schema: dimensions, facts, precipitation, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.functions import calendar, scalars
from loopweave.operators import aggregates, dimensions, history, quality, reshape, spatial
from loopweave.schemas import DIRECTION_FROM_ZERO
from loopweave.session import staged
from loopweave.sources import published, readers


def regression_extract(profiles: DataFrame, stations: DataFrame, types: DataFrame,
                       freeways: DataFrame, homes: DataFrame, incidents: DataFrame,
                       metres: float = 804.672, monthly: bool = True) -> DataFrame:
    """One row per mainline station-day (and nearby incident) with all features.

    ``profiles`` carries ``id`` of the station version and ``date``; home values
    match on ZIP and, when ``monthly``, on the calendar month. Small dimensions
    join first, the spatial incident join last.
    """
    mainline = types.filter(F.col("type") == "ML").select(F.col("id").alias("type_id"))
    sites = (stations.join(mainline, "type_id", "left_semi")
             .join(freeways.select(F.col("id").alias("fwy_id"), F.col("num").alias("fwy_num"),
                                   "direction"), "fwy_id"))
    values = homes.select("zip", "month", "avg_value")
    if monthly:
        rows = (profiles.withColumn("_month", F.trunc("date", "month"))
                .join(sites, "id")
                .join(values.withColumnRenamed("month", "_month"), ["zip", "_month"])
                .drop("_month"))
    else:
        rows = profiles.join(sites.join(values.drop("month"), "zip"), "id")
    near = incidents.withColumn("day", F.to_date("time"))
    # One station-day is one row, so no cell of a freeway and day can be crowded.
    joined = spatial.near_join(rows, near, metres, {"fwy_id": "fwy_id", "date": "day"},
                               crowded=None)
    found = F.col("id_r").isNotNull()
    features = [c for c in rows.columns if c not in (
        "id", "fwy_id", "direction", "latitude", "longitude", "type_id")]
    return joined.select(
        F.col("id").alias("s_id"), *features,
        scalars.direction_code(F.col("direction"), DIRECTION_FROM_ZERO).alias("fwy_dir"),
        scalars.yes_no(found).alias("chp_inc"), F.col("id_r").alias("incident"),
        scalars.incident_code(F.col("description_r")).alias("cc_code"),
        scalars.incident_text(F.col("description_r")).alias("chp_desc"),
        F.col("duration_r").alias("chp_duration"))


def _clean_stations(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, rows without any coordinate) of raw station metadata.

    The cleaned rows are staged in the shared folder, because every table of the
    load reads them.
    """
    sited = quality.Rule("latitude or longitude", F.col("latitude").isNotNull()
                         | F.col("longitude").isNotNull(), ("latitude", "longitude"), "nonempty")
    valid, rejected = quality.screened(meta, [sited])
    return staged(valid.withColumn("city", F.coalesce("city", F.lit(-1)))
                  .withColumn("state_pm", scalars.postmile(F.col("state_pm"))), "stations"), rejected


def _freeways_of(clean: DataFrame) -> DataFrame:
    return clean.select(F.col("fwy").alias("num"), F.col("dir").alias("direction"),
                        F.col("district").alias("district_id"))


def _versions_of(clean: DataFrame, types: DataFrame, freeways: DataFrame, places: DataFrame
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, the rows behind them, rows whose type, freeway or place is unknown)."""
    typed = dimensions.lookup(clean, types, {"type": "type"}, {"id": "type_id"}, "left")
    known = dimensions.lookup(typed, freeways, {"fwy": "num", "dir": "direction"},
                              {"id": "fwy_id"}, "left")
    known = dimensions.lookup(known, places, {"county": "county", "city": "city"},
                              {"id": "cc_id"}, "left")
    matched, unmatched = dimensions.placed(known, "type_id", "fwy_id", "cc_id")
    versions = matched.select(
        F.col("id").alias("sensor_id"), "eff_start", "name", "fwy_id", "cc_id", "type_id",
        "state_pm", "abs_pm", "latitude", "longitude", "length", "lanes",
        scalars.point_text(F.col("latitude"), F.col("longitude")).alias("location"))
    return versions, matched, unmatched


def station_dimension(meta: DataFrame, types: DataFrame) -> dict[str, DataFrame]:
    """Freeways, county_city and versioned stations from raw station metadata.

    ``meta`` is what ``read_station_meta`` returns. ``rejected`` has the rows without
    any coordinate, ``unmatched`` those whose type, freeway or place is unknown; with
    ``matched`` they make up all rows. Ids are those of a first load; ``station_load``
    keeps them over further ones.
    """
    clean, rejected = _clean_stations(meta)
    freeways = dimensions.dimension(_freeways_of(clean), ["num", "direction"], ["district_id"])
    places = dimensions.dimension(clean.select("county", "city"), ["county", "city"])
    versions, matched, unmatched = _versions_of(clean, types, freeways, places)
    return {"freeways": freeways, "county_city": places, "rejected": rejected,
            "unmatched": unmatched, "matched": matched,
            "traffic_station": dimensions.numbered_history(versions, "sensor_id", "eff_start",
                                                           tie_break=["name"])}


def station_load(meta: DataFrame, types: DataFrame, root: str) -> dict[str, DataFrame]:
    """N12 into a published star: the next snapshot of the stations, ids kept.

    Freeways, places and versions that are new get the next ids; all others keep
    theirs. The three tables are published together or not at all. ``moved`` has the
    versions whose end this load changed.
    """
    spark = meta.sparkSession
    after = published.version(spark, root)
    old = after.tables if after else {}
    clean, rejected = _clean_stations(meta)
    made = {"freeways": history.merged_dimension(
                spark, root, old.get("freeways"), _freeways_of(clean), ["num", "direction"],
                ["district_id"]),
            "county_city": history.merged_dimension(
                spark, root, old.get("county_city"), clean, ["county", "city"])}
    versions, _, unmatched = _versions_of(clean, types, *(
        published.table(spark, made[n]) for n in ("freeways", "county_city")))
    made["traffic_station"] = history.merged_history(
        spark, root, old.get("traffic_station"), versions, tie_break=["name"])
    if any(made[n] is not old.get(n) for n in made):
        published.publish(spark, root, made, after)
    tables = {n: published.table(spark, t) for n, t in made.items()}
    before = old.get("traffic_station")
    moved = history.moved(published.table(spark, before) if before
                          else tables["traffic_station"].limit(0), tables["traffic_station"])
    return tables | {"rejected": rejected, "unmatched": unmatched, "moved": moved}


def incident_load(raw: DataFrame, freeways: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """``incident`` with foreign keys, ``rejected`` without coordinates, ``unmatched``
    whose freeway or place is unknown. The three make up all rows."""
    valid, rejected = quality.screened(raw, quality.not_null("latitude", "longitude"))
    rows = valid.fillna(-1, subset=["city_fips_id"])
    rows = dimensions.lookup(rows, freeways, {"freeway_num": "num", "freeway_dir": "direction"},
                             {"id": "fwy_id"}, "left")
    rows = dimensions.lookup(rows, places, {"county_fips_id": "county", "city_fips_id": "city"},
                             {"id": "cc_id"}, "left")
    rows, unmatched = dimensions.placed(rows, "fwy_id", "cc_id")
    text = F.col("description")
    incidents = rows.select(
        "id", "cc_code", "incident_num", calendar.feed_time(F.col("timestamp")).alias("time"),
        scalars.incident_code(text).alias("desc_id"), scalars.incident_text(text).alias("description"),
        "location", "area", "latitude", "longitude", "fwy_id", "cc_id",
        scalars.postmile(F.col("state_pm")).alias("state_pm"), "absolute_pm", "severity",
        "duration")
    return {"incident": incidents, "rejected": rejected, "unmatched": unmatched}


def incident_fact(raw: DataFrame, freeways: DataFrame, places: DataFrame) -> DataFrame:
    """The valid, matched rows of ``incident_load``."""
    return incident_load(raw, freeways, places)["incident"]


def incident_descriptions(raw: DataFrame) -> DataFrame:
    """Distinct (code, text) of the incident feed; one text per code."""
    text = F.col("description")
    rows = raw.select(scalars.incident_code(text).alias("id"),
                      scalars.incident_text(text).alias("description"))
    return dimensions.first_per_key(rows.dropna(subset=["id"]), ["id"], ["description"])


def observation_facts(lines: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """Validated observations with their station version, and their lanes.

    ``lines`` is what ``read_station_feed`` returns. A line carries its station,
    its reading and its lanes, so the rules of all three are filters on it, and
    the lane rows of a kept line need no join to find their observation.
    ``rejected`` has the lines that break a rule, ``rejected_lane`` the lanes of
    kept lines that do, ``unmatched`` the facts without a station version, which
    stay among the observations with the version -1.
    """
    rules = [*quality.sensor_rules(), *quality.observation_rules("avg_occupancy",
                                                                 "observation_id")]
    known, rejected = quality.screened(lines, rules)
    facts = dimensions.version_at(
        readers.observation_part(known).withColumn("day", F.to_date("time")), history, "station",
        "day", "sensor_id").drop("day")
    lanes, rejected_lanes = quality.screened(readers.lane_part(known), quality.lane_rules())
    return {"observation": facts, "lane_observation": lanes, "rejected": rejected,
            "rejected_lane": rejected_lanes,
            "unmatched": facts.filter(F.col("station_version") == -1)}


def precipitation_facts(records: DataFrame, stations: DataFrame) -> dict[str, DataFrame]:
    """Hourly and daily precipitation from raw fixed-width records.

    ``rejected`` has the records that break a rule, ``unmatched`` the readings of
    unknown stations, ``rejected_hourly`` and ``rejected_daily`` the located ones
    that break a rule of their table.
    """
    valid, rejected = quality.screened(records, quality.precipitation_rules())
    typed = valid.select(
        F.col("station_number").cast("int").alias("station_number"),
        F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
        F.col("day").cast("int").alias("day"), F.col("value_count").cast("int").alias("value_count"),
        "values")
    readings = reshape.explode_precipitation(typed)
    located = dimensions.lookup(readings, stations, {"station_number": "id"},
                                {"id": "station_id"}, "left")
    located, unmatched = dimensions.placed(located, "station_id")
    hourly = quality.hourly_readings(located)
    daily = quality.daily_totals(located)
    parts = F.col("year"), F.col("month"), F.col("day")
    hourly, rejected_hourly = quality.screened(hourly, quality.daily_rules())
    daily, rejected_daily = quality.screened(daily, quality.daily_rules())
    return {
        "rejected": rejected, "unmatched": unmatched, "rejected_hourly": rejected_hourly,
        "rejected_daily": rejected_daily,
        "hourly": hourly.select(
            "station_id", calendar.from_parts(*parts, F.col("hour")).alias("time"), "amount",
            "flag1", "flag2"),
        "daily": daily.select(
            "station_id", F.make_date(*parts).alias("day"), "amount", "flag1", "flag2"),
    }


def enriched_stations(readings: DataFrame, places: DataFrame, urban: DataFrame, zips: DataFrame,
                      density: DataFrame) -> DataFrame:
    """The most common description of every station, urban flag, ZIP and its density."""
    described = aggregates.most_common(readings, ["station"], ["direction", "freeway", "district",
                                                               "type"]).drop("n")
    located = described.join(places, "station", "left")
    flagged = spatial.containing_area(located, urban, "area", "_area")
    flagged = flagged.withColumn("urban", F.col("_area").isNotNull().cast("int")).drop("_area")
    zipped = spatial.containing_area(flagged, zips, "zip", "zip")
    return dimensions.lookup(zipped, density, {"zip": "zip"}, {"density": "density"}, "left")


def home_values(wide: DataFrame, first_year: int = 2008) -> dict[str, DataFrame]:
    """ZIP places and monthly values from the wide home-value file."""
    typed = wide.withColumn("zip", F.col("RegionName").try_cast("long"))
    places = typed.select("zip", F.regexp_replace("City", "'", "").alias("city"),
                          F.col("State").alias("state"), F.col("Metro").alias("metro"),
                          F.col("CountyName").alias("county"))
    values = reshape.unpivot_months(typed, "zip", first_year)
    return {"county_zip": places,
            "home_value": values.withColumnRenamed("value", "avg_value")}
