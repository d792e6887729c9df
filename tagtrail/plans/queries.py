"""Named queries over the test tables. Each is registered with the SQL that must give the same
rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import binning, frames, labels
from ..operators import (clustering, communities, components, exhibitions, features, graph,
                         journeys, linkage, locations, metadata, ranking, selection, similarity,
                         statistics, summaries, times)
from ..scale.durable import scratch_path, stored
from ..scale.skew import lookup_join
from ..sources import dumps, files, store
from .model_views import Views
from .oracle import pagerank_views, propagation_views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAGERANK_TOL = 0.01
LABEL_ROUNDS = 50
DIMENSIONS = 64
E_COLUMNS = [f"e{i}" for i in range(DIMENSIONS)]
REFERENCES = 10
# Starts for each k of the sweep; every other k-means query has the hundred.
SWEEP_STARTS = 10
# Share of the feature rows that is drawn for linkage.
SAMPLED = 0.00275


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, floating point to six decimals: equal in any engine."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            # Adding zero turns a negative zero into zero.
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, T.DayTimeIntervalType):
            c = F.extract(F.lit("DAY"), c).cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(build(Views(spark, sf_dir)))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


# --- sources and sinks -------------------------------------------------------------------------

TAG_ROWS = with_views("tags", sql="SELECT * FROM tags")


@query("tag_log_csv", with_views("tags", sql="""
SELECT id, CAST(tool_id AS BIGINT) AS tool_id, bundle_id, refers_to_object_id, created FROM tags
"""))
def tag_log_csv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "tags-csv")
    files.write_csv(v.tags, path)
    return files.read_tag_log(v.spark, path)


@query("tag_snapshot", TAG_ROWS)
def tag_snapshot(v: Views) -> DataFrame:
    """Built and written by the first call, loaded by the second, which must not build."""
    path = scratch_path(v.spark, "tags-snapshot")
    files.load_or_build(v.spark, path, ["tags"], lambda: {"tags": v.tags})
    return files.load_or_build(v.spark, path, ["tags"], lambda: {})["tags"]


def _pages(v: Views, records: DataFrame, field: str, key: str = "id", per_page: int = 500) -> str:
    """A dump of records: JSON lines, a page of about ``per_page`` records on each, with the
    declared total; many pages to a file. A dot in ``field`` makes the list a field of a struct."""
    path = scratch_path(v.spark, field.replace(".", "-"))
    total = records.count()
    page = F.pmod(F.xxhash64(key), F.lit(max(1, -(-total // per_page)))).alias("page")
    outer, _, inner = field.partition(".")
    listed = F.collect_list(F.struct(*records.columns)).alias(inner or outer)
    pages = records.groupBy(page).agg(listed)
    files.write_json(pages.select(
        F.struct(inner).alias(outer) if inner else F.col(outer), F.lit(total).alias("total"),
        F.lit("ok").alias("stat")), path)
    return path


def _object_pages(v: Views) -> str:
    return _pages(v, v.objects, "objects")


@query("object_pages", with_views("objects", sql="SELECT * FROM objects"))
def object_pages(v: Views) -> DataFrame:
    return dumps.site_objects(v.spark, _object_pages(v)).select(*v.objects.columns)


@query("page_completeness", with_views("objects", sql="""
SELECT count(*) AS found, count(*) AS total, true AS complete FROM objects"""))
def page_completeness(v: Views) -> DataFrame:
    return dumps.page_completeness(v.spark, _object_pages(v), "objects", schemas.OBJECT_PAGES)


@query("site_summary", with_views("rooms", "spots", "objects", sql="""
SELECT '1' AS id, 'Site' AS name, (SELECT count(*) FROM objects) AS count_objects,
       (SELECT count(*) FROM rooms) AS count_rooms, (SELECT count(*) FROM spots) AS count_spots"""))
def site_summary(v: Views) -> DataFrame:
    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))
    figures = size(v.objects, "count_objects").join(size(v.rooms, "count_rooms")) \
        .join(size(v.spots, "count_spots"))
    site = figures.select(F.lit("1").alias("id"), F.lit("Site").alias("name"), "*")
    return dumps.site_summary(v.spark, _pages(v, site, "sites.site"))


@query("site_departments", with_views("departments", sql="SELECT id, name FROM departments"))
def site_departments(v: Views) -> DataFrame:
    return dumps.site_departments(v.spark, _pages(v, v.departments, "departments"))


@query("site_exhibitions", with_views("exhibitions", sql="""
SELECT id, 'Exhibition ' || id AS title, date_start, date_end FROM exhibitions"""))
def site_exhibitions(v: Views) -> DataFrame:
    listed = v.exhibitions.select("id", F.concat(F.lit("Exhibition "), "id").alias("title"),
                                  "date_start", "date_end")
    return dumps.site_exhibitions(v.spark, _pages(v, listed, "exhibitions"))


@query("site_rooms", with_views("rooms", sql="""
SELECT CAST(id AS VARCHAR) AS id, name, CAST(floor AS BIGINT) AS floor, count_objects, count_spots
FROM rooms"""))
def site_rooms(v: Views) -> DataFrame:
    return dumps.site_rooms(v.spark, _pages(v, v.rooms, "rooms.room"))


@query("site_spots", with_views("spots", "visits", sql="""
SELECT CAST(s.id AS VARCHAR) AS id, s.name, s.description, CAST(r.room_id AS VARCHAR) AS room_id,
       s.count_objects
FROM spots s JOIN (SELECT DISTINCT spot_id, room_id FROM visits) r ON r.spot_id = s.id"""))
def site_spots(v: Views) -> DataFrame:
    # Of the suppliers' places those that have a visit.
    met = v.table("lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    rooms = v.places.select(F.col("s_suppkey").alias("id"), F.col("n_nationkey").alias("room_id")) \
        .distinct().join(met, "id", "left_semi")
    return dumps.site_spots(v.spark, _pages(v, v.spots.join(rooms, "id"), "spots.spot"))


@query("site_types", with_views("objects", sql="""
SELECT DISTINCT type_id AS id, type AS name FROM objects"""))
def site_types(v: Views) -> DataFrame:
    types = v.objects.select(F.col("type_id").alias("id"), F.col("type").alias("name")).distinct()
    return dumps.site_types(v.spark, _pages(v, types, "types"))


@query("exhibition_pages", with_views("members", sql="""
SELECT CAST(exhibition_id AS VARCHAR) AS exhibition_id, object_id FROM members"""))
def exhibition_pages(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "exhibition-pages")
    files.write_json(_member_documents(v).withColumnRenamed("_id", "exhibition_id"), path)
    return exhibitions.exhibition_objects(dumps.exhibition_documents(v.spark, path))


@query("json_records", with_views("objects", sql="SELECT * FROM objects"))
def json_records(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "objects-json")
    files.write_json(v.objects, path)
    return files.read_json(v.spark, path, v.objects.schema)


@query("objects_tsv", with_views("objects", sql="SELECT * FROM objects"))
def objects_tsv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "objects-tsv")
    files.write_tsv(v.objects, path)
    return files.read_tsv(v.spark, path, v.objects.schema)


@query("tag_log_reordered", with_views("tags", sql="""
SELECT id, CAST(tool_id AS BIGINT) AS tool_id, bundle_id, refers_to_object_id, created FROM tags
"""))
def tag_log_reordered(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "tags-reordered")
    files.write_csv(v.tags.select("created", F.lit("x").alias("note"), "bundle_id",
                                  "refers_to_object_id", "id", "tool_id"), path)
    return files.read_tag_log(v.spark, path)


def _member_documents(v: Views) -> DataFrame:
    """Exhibition documents in parts of at most about a thousand objects."""
    part = F.floor(F.col("object_id") / 20_000)
    return v.exhibition_members.groupBy(F.col("exhibition_id").cast("string").alias("_id"),
                                        part.alias("part")) \
        .agg(F.collect_list(F.struct(F.col("object_id").alias("id"))).alias("objects")) \
        .select("_id", "objects")


@query("exhibition_objects", with_views("members", sql="""
SELECT CAST(exhibition_id AS VARCHAR) AS exhibition_id, object_id FROM members"""))
def exhibition_objects(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "exhibition-documents")
    store.replace_documents(_member_documents(v), path)
    return exhibitions.exhibition_objects(store.read_documents(v.spark, path))


@query("exhibition_document", with_views("members", sql="""
SELECT '105' AS _id, object_id FROM members WHERE exhibition_id = '105'"""))
def exhibition_document(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "exhibition-documents")
    store.replace_documents(_member_documents(v), path)
    return store.find_document(v.spark, path, "105") \
        .select("_id", F.explode("objects").alias("o")) \
        .select("_id", F.col("o.id").alias("object_id"))


@query("graph_roundtrip", with_views("edges", sql="SELECT src, dst FROM edges"))
def graph_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "edges")
    files.write_snapshot(v.edges, path)
    return files.read_snapshot(v.spark, path)


# --- tag log -----------------------------------------------------------------------------------

@query("tag_time_features", with_views("calendar", sql="""
SELECT id, tool_id, bundle_id, refers_to_object_id, created,
       strftime(utc, '%Y-%m-%d %H:%M:%S') AS created_dateformat,
       strftime(utc, '%Y-%m-%d') AS created_date,
       strftime(utc, '%Y-%m-%d %H:%M:%S') AS created_dateformat_utc,
       strftime(wall, '%Y-%m-%d %H:%M:%S') AS created_dateformat_est,
       strftime(local_day, '%Y-%m-%d') AS created_date_est,
       strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS created_dateformat_hr_utc,
       strftime(hour_wall, '%Y-%m-%d %H:%M:%S') AS created_dateformat_hr_est,
       month, year, day, dow, week, weekend, hour, quarter, visitor_drawn
FROM calendar"""))
def tag_time_features(v: Views) -> DataFrame:
    return times.tag_time_features(v.tags)


@query("closing_time_flag", with_views("calendar", sql="""
SELECT id, tagged_after_close FROM calendar"""))
def closing_time_flag(v: Views) -> DataFrame:
    return v.timed.select("id", "tagged_after_close")


@query("wall_tags", with_views("tags", sql="""
SELECT * FROM tags WHERE tool_id = 0 AND refers_to_object_id <> 0"""))
def wall_tags(v: Views) -> DataFrame:
    return times.wall_tags(v.tags)


@query("visitor_created", with_views("tags", sql="SELECT * FROM tags WHERE tool_id <> 0"))
def visitor_created(v: Views) -> DataFrame:
    return times.visitor_created(v.tags)


@query("flat_samples", with_views("featured", sql="""
SELECT id, tool_id, bundle_id, refers_to_object_id, created, month, year, day, dow, week, weekend,
       hour, quarter, visitor_drawn, tagged_after_close, during_exhibition FROM featured"""))
def flat_samples(v: Views) -> DataFrame:
    columns = ["id", "tool_id", "bundle_id", "refers_to_object_id", "created", *times.CALENDAR,
               "visitor_drawn", "tagged_after_close", "during_exhibition"]
    return frames.drop_time_columns(v.featured).select(*columns)


@query("exhibitions_clean", with_views("clean", sql="""
SELECT id, ordinal, date_start, date_end, strftime(starts, '%Y-%m-%d') AS created_date_start,
       strftime(ends, '%Y-%m-%d') AS created_date_end,
       date_diff('day', starts, ends) AS created_time_span FROM clean"""))
def exhibitions_clean(v: Views) -> DataFrame:
    return exhibitions.exhibitions_clean(v.exhibitions)


@query("during_exhibition", with_views("featured", sql="""
SELECT id, during_exhibition FROM featured"""))
def during_exhibition(v: Views) -> DataFrame:
    return v.featured.select("id", "during_exhibition")


@query("during_any_exhibition", with_views("timed", "members", "clean", sql="""
SELECT id, CASE WHEN EXISTS (
         SELECT 1 FROM members m JOIN clean c ON c.id = m.exhibition_id
         WHERE m.object_id = t.refers_to_object_id AND t.local_day >= c.starts
           AND t.local_day < c.ends) THEN 1 ELSE 0 END AS during_exhibition
FROM timed t"""))
def during_any_exhibition(v: Views) -> DataFrame:
    return exhibitions.during_exhibition(
        v.timed, exhibitions.exhibitions_clean(v.exhibitions), v.exhibition_members,
        mode="any").select("id", "during_exhibition")


@query("bundle_journeys", with_views("steps", sql="""
SELECT bundle_id, strftime(local_day, '%Y-%m-%d') AS created_date_est,
       CAST(row_number() OVER (PARTITION BY bundle_id, local_day ORDER BY created) - 1 AS INT)
         AS place, created, object_id FROM steps"""))
def bundle_journeys(v: Views) -> DataFrame:
    return journeys.bundle_journeys(v.tags) \
        .select("bundle_id", "created_date_est", F.posexplode("steps").alias("place", "s")) \
        .select("bundle_id", "created_date_est", "place", "s.*")


@query("bundle_object_journeys", with_views("steps", sql="""
SELECT bundle_id, strftime(local_day, '%Y-%m-%d') AS created_date_est,
       string_agg(CAST(object_id AS VARCHAR), ',' ORDER BY created) AS objects,
       CAST(count(*) AS INT) AS length
FROM steps GROUP BY 1, 2"""))
def bundle_object_journeys(v: Views) -> DataFrame:
    return journeys.bundle_journeys(v.tags).select(
        "bundle_id", "created_date_est",
        F.array_join(F.col("object_ids").cast("array<string>"), ",").alias("objects"),
        F.size("object_ids").alias("length"))


@query("journey_buckets", with_views("rolled", sql="""
SELECT bundle_id, strftime(local_day, '%Y-%m-%d') AS created_date_est, bucket, n,
       round(two / 2, 6) AS rolling_mean FROM rolled"""))
def journey_buckets(v: Views) -> DataFrame:
    return journeys.resampled_counts(v.tags)


@query("burst_anomalies", with_views("bursts", sql="""
SELECT bundle_id, strftime(local_day, '%Y-%m-%d') AS created_date_est, n_obs, n_anomalies
FROM bursts"""))
def burst_anomalies(v: Views) -> DataFrame:
    return journeys.burst_anomalies(v.tags)


def _bursty(v: Views) -> DataFrame:
    return journeys.bursty_tags(v.timed, journeys.burst_anomalies(v.tags))


@query("bursty_tags", with_views("bursty", sql="""
SELECT id, n_obs, n_anomalies, bursty FROM bursty"""))
def bursty_tags(v: Views) -> DataFrame:
    return _bursty(v).select("id", "n_obs", "n_anomalies", "bursty")


# --- locations -----------------------------------------------------------------------------------

@query("locations_flat", with_views("visits", sql="""
SELECT refers_to_object_id, location_id, visit_raw,
       strftime(make_timestamp(visit_raw * 1000000), '%Y-%m-%d %H:%M:%S') AS visit_time,
       strftime(make_timestamp(visit_raw * 1000000), '%Y-%m-%d') AS visit_date,
       CAST(room_id AS BIGINT) AS room_id, room_name, CAST(room_floor AS BIGINT) AS room_floor,
       spot_id, spot_name, spot_description, CAST(room_id AS BIGINT) AS spot_room_id
FROM visits
QUALIFY row_number() OVER (
  PARTITION BY refers_to_object_id, visit_raw // 86400, room_id, spot_id
  ORDER BY visit_raw, location_id) = 1"""))
def locations_flat(v: Views) -> DataFrame:
    return locations.locations_flat(v.nested_objects)


@query("repeated_objects", with_views("visits", sql="""
SELECT refers_to_object_id, count(*) AS n FROM visits GROUP BY 1 HAVING count(*) > 1"""))
def repeated_objects(v: Views) -> DataFrame:
    return locations.repeated_objects(v.visits)


@query("rooms_table", with_views("rooms", "spots", sql="""
SELECT r.id, r.name, r.floor, r.count_objects AS room_count_objects, r.count_spots,
       (SELECT arg_min(s.description, s.id) FROM spots s
        WHERE trim(split_part(s.name, ',', 2)) = r.name) AS description
FROM rooms r"""))
def rooms_table(v: Views) -> DataFrame:
    return locations.rooms_table(v.rooms, v.spots)


@query("object_loctypes", with_views("loctypes", sql="""
SELECT * REPLACE (strftime(visit_date, '%Y-%m-%d') AS visit_date) FROM loctypes"""))
def object_loctypes(v: Views) -> DataFrame:
    return v.loctypes


@query("nearest_location", with_views("located", sql="""
SELECT id, tool_id, bundle_id, refers_to_object_id, created, visit_raw, delta, room_floor,
       room_id, room_name, spot_id, spot_name, spot_description, room_count_objects,
       room_count_spots, spot_count_objects, meta_store FROM located"""))
def nearest_location(v: Views) -> DataFrame:
    return locations.nearest_location(v.tags, v.locations, keep=("visit_raw", "delta"))


@query("tag_location_deltas", with_views("timed", "locations", sql="""
SELECT refers_to_object_id, strftime(day, '%Y-%m-%d') AS created_date, n_tags,
       strftime(last, '%Y-%m-%d') AS last_visit, strftime(next, '%Y-%m-%d') AS next_visit,
       CAST(date_diff('day', last, day) AS INT) AS days_since,
       CAST(date_diff('day', day, next) AS INT) AS days_until
FROM (SELECT t.refers_to_object_id, t.day, t.n_tags,
             max(l.visit_date) FILTER (l.visit_date <= t.day) AS last,
             min(l.visit_date) FILTER (l.visit_date > t.day) AS next
      FROM (SELECT refers_to_object_id, CAST(utc AS DATE) AS day, count(*) AS n_tags
            FROM timed GROUP BY 1, 2) t
      JOIN (SELECT DISTINCT refers_to_object_id, visit_date FROM locations) l
        USING (refers_to_object_id) GROUP BY 1, 2, 3)"""))
def tag_location_deltas(v: Views) -> DataFrame:
    return locations.tag_location_deltas(v.tags, v.visits)


# --- features --------------------------------------------------------------------------------------

@query("room_capacity_bins", with_views("binned", sql="SELECT id, room_capacity FROM binned"))
def room_capacity_bins(v: Views) -> DataFrame:
    return features.room_capacity_bins(features.prepare(v.modelled)).select("id", "room_capacity")


@query("spot_turnover_bins", with_views("binned", sql="SELECT id, spot_turnover FROM binned"))
def spot_turnover_bins(v: Views) -> DataFrame:
    return features.spot_turnover_bins(features.prepare(v.modelled)).select("id", "spot_turnover")


def _flag_sql(levels: dict[str, list], column: str, prefix: str = "") -> list[str]:
    return [f"""CASE WHEN {column} = {repr(k)} THEN 1 ELSE 0 END AS "{name}\""""
            for k, name in levels.items()]


def _matrix_sql() -> str:
    parts = []
    for column, names in (("hour_bin", binning.HOUR_LABELS),
                          ("room_capacity", binning.ROOM_LABELS),
                          ("spot_turnover", binning.SPOT_LABELS)):
        parts += _flag_sql({n: n for n in names}, column)
    parts += _flag_sql({0: "Mon", 1: "Tues", 2: "Wed", 3: "Thur", 4: "Fri"}, "dow")
    # The levels that the test tables hold.
    for column, prefix, values in (("wom", "wom", range(1, 5)), ("year", "year", (2023, 2024)),
                                   ("month", "month", (1, 12)), ("quarter", "quarter", (1, 4)),
                                   ("room_id", "room", range(25)),
                                   ("room_floor", "floor", range(1, 6))):
        parts += _flag_sql({i: f"{prefix}_{i}" for i in values}, column)
    parts += ["bursty AS is_bursty", *features.FLAGS]
    return f"SELECT id, {', '.join(parts)} FROM binned"


@query("feature_matrix", with_views("binned", sql=_matrix_sql()))
def feature_matrix(v: Views) -> DataFrame:
    return features.feature_matrix(v.modelled)


# --- summaries -------------------------------------------------------------------------------------

METRICS_SQL = """
facts AS (
  SELECT count(CASE WHEN tool_id = 0 THEN 1 END) AS n_wall_objects_tagged,
         count(CASE WHEN tool_id <> 0 THEN 1 END) AS n_visitor_objects_tagged,
         count(DISTINCT coalesce(refers_to_object_id, -1)) AS n_unique_wallobjects,
         count(DISTINCT coalesce(bundle_id, '')) AS n_unique_bundles,
         count(*) AS n_tags,
         (SELECT count(*) FROM (SELECT DISTINCT refers_to_object_id FROM featured)
          WHERE refers_to_object_id NOT IN (SELECT id FROM objects)) AS n_objects_meta_delta,
         count(CASE WHEN refers_to_object_id IN (SELECT id FROM objects) THEN 1 END)
           AS nobs_meta_delta,
         count(CASE WHEN refers_to_object_id NOT IN (SELECT id FROM objects) THEN 1 END)
           AS n_afterhrs_tags,
         count(CASE WHEN during_exhibition = 1 THEN 1 END) AS n_during_exhibition_tags,
         count(CASE WHEN during_exhibition = 0 THEN 1 END) AS n_nonexhibition_tags,
         (SELECT CAST(floor(avg(n)) AS BIGINT)
          FROM (SELECT count(*) AS n FROM featured GROUP BY bundle_id, local_day))
           AS n_avgdaily_tags,
         (SELECT CAST(floor(avg(n)) AS BIGINT)
          FROM (SELECT count(*) AS n FROM featured GROUP BY bundle_id, hour_utc))
           AS n_avgdailyhr_tags
  FROM featured),
metrics AS (UNPIVOT facts ON COLUMNS(*) INTO NAME metric VALUE value)"""


@query("tag_metrics", with_views("featured", "objects", sql=f"WITH {METRICS_SQL}\n"
                                 "SELECT metric, value FROM metrics"))
def tag_metrics(v: Views) -> DataFrame:
    return summaries.tag_metrics(v.featured, v.objects)


BURST_SQL = """
burst_metrics AS (
  SELECT 'n_tags_via_bursty' AS metric, CAST(sum(bursty) AS BIGINT) AS value FROM bursty
  UNION ALL SELECT 'n_anomalies_total', CAST(sum(n_anomalies) AS BIGINT) FROM bursts
  UNION ALL SELECT 'n_bursty_journeys', count(*) FROM bursts WHERE n_anomalies > 0)"""


@query("burst_metrics", with_views("bursty", sql=f"WITH {BURST_SQL}\nSELECT * FROM burst_metrics"))
def burst_metrics(v: Views) -> DataFrame:
    bursts = journeys.burst_anomalies(v.tags)
    return summaries.burst_metrics(_bursty(v), bursts)


@query("displayed_metrics", with_views(
    "bursty", "featured", "objects", sql=f"WITH {METRICS_SQL},\n{BURST_SQL}\n" + """
SELECT CASE metric WHEN 'n_tags' THEN '# tags'
         WHEN 'n_wall_objects_tagged' THEN '# wall artworks tagged'
         WHEN 'n_visitor_objects_tagged' THEN '# visitor artworks created tags'
         WHEN 'n_during_exhibition_tags' THEN '# exhibition tags'
         WHEN 'n_afterhrs_tags' THEN '# after hours tags'
         WHEN 'n_tags_via_bursty' THEN '# tags via bursty visitors' END AS metric, value
FROM (SELECT metric, value FROM metrics UNION ALL SELECT metric, value FROM burst_metrics)
WHERE metric IN ('n_tags', 'n_wall_objects_tagged', 'n_visitor_objects_tagged',
                 'n_during_exhibition_tags', 'n_afterhrs_tags', 'n_tags_via_bursty')"""))
def displayed_metrics(v: Views) -> DataFrame:
    bursts = journeys.burst_anomalies(v.tags)
    found = summaries.tag_metrics(v.featured, v.objects).unionByName(
        summaries.burst_metrics(_bursty(v), bursts))
    return summaries.displayed_metrics(found)


def _register_scans() -> None:
    for part in ("month", "year", "day", "dow", "quarter"):
        query(f"scans_per_{part}", with_views("calendar", sql=f"""
SELECT {part}, count(*) AS n_tags FROM calendar GROUP BY 1"""))(
            lambda v, part=part: summaries.scans_per(times.tag_time_features(v.tags), part))


_register_scans()


@query("scans_per_hour", with_views("calendar", sql="""
SELECT hour, count(*) AS n_tags,
       CASE WHEN hour > 12 THEN CAST(hour - 12 AS VARCHAR) || 'pm'
            WHEN hour = 12 THEN '12pm' ELSE CAST(hour AS VARCHAR) || 'am' END AS label
FROM calendar WHERE hour BETWEEN 5 AND 23 GROUP BY 1"""))
def scans_per_hour(v: Views) -> DataFrame:
    return summaries.scans_per_hour(times.tag_time_features(v.tags))


@query("scans_per_exhibition", with_views("featured", sql="""
SELECT during_exhibition, count(*) AS n_tags,
       CASE during_exhibition WHEN 0 THEN 'non-exhibitions' ELSE 'exhibitions' END AS label
FROM featured GROUP BY 1"""))
def scans_per_exhibition(v: Views) -> DataFrame:
    return summaries.scans_per_exhibition(v.featured)


@query("scans_per_closing", with_views("calendar", sql="""
SELECT tagged_after_close, count(*) AS n_tags,
       CASE tagged_after_close WHEN 0 THEN 'open hours' ELSE 'after hours' END AS label,
       round(ln(count(*)), 6) AS log_n_tags
FROM calendar GROUP BY 1"""))
def scans_per_closing(v: Views) -> DataFrame:
    return summaries.log_counts(summaries.scans_per_closing(v.timed))


@query("popular_floors", with_views("located", sql="""
SELECT room_floor, count(*) AS n_tags FROM located WHERE room_floor IS NOT NULL GROUP BY 1"""))
def popular_floors(v: Views) -> DataFrame:
    return summaries.popular_floors(locations.nearest_location(v.tags, v.locations))


@query("popular_rooms", with_views("locations", sql="""
SELECT room_name, count(*) AS location_rows FROM locations GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 7"""))
def popular_rooms(v: Views) -> DataFrame:
    return summaries.popular_rooms(v.visits)


@query("popular_spots", with_views("locations", sql="""
SELECT spot_name, count(*) AS location_rows, trim(split_part(spot_name, ',', 3)) AS spot_label
FROM locations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"""))
def popular_spots(v: Views) -> DataFrame:
    return summaries.popular_spots(v.visits)


@query("first_tag_items", with_views("starts", sql="""
SELECT object_id, count(*) AS n_journeys FROM starts GROUP BY 1"""))
def first_tag_items(v: Views) -> DataFrame:
    return summaries.first_tag_items(v.tags)


@query("first_tag_rooms", with_views("starts", "objects", "locations", sql="""
SELECT l.room_name, count(*) AS n_first_tags
FROM starts s JOIN objects o ON o.id = s.object_id
     JOIN locations l ON l.refers_to_object_id = s.object_id
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"""))
def first_tag_rooms(v: Views) -> DataFrame:
    return summaries.first_tag_rooms(v.tags, v.objects, v.visits)


@query("high_capacity_rooms", with_views("rooms", sql="""
SELECT id, name, count_objects, count_spots FROM rooms
ORDER BY count_objects DESC, count_spots DESC, id LIMIT 7"""))
def high_capacity_rooms(v: Views) -> DataFrame:
    return summaries.high_capacity_rooms(v.rooms)


TYPES = ["PROMO", "STANDARD", "ECONOMY", "Drawing"]


@query("room_types", with_views("loctypes", sql="""
SELECT type AS query, room_name, n FROM (
  SELECT type, room_name, count(*) AS n FROM loctypes
  WHERE type IN ('PROMO', 'STANDARD', 'ECONOMY', 'Drawing') GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, room_name) <= 5"""))
def room_types(v: Views) -> DataFrame:
    return summaries.room_types(v.loctypes, TYPES) \
        .select("query", F.explode("rooms").alias("room_name", "n"))


@query("types_in_room", with_views("loctypes", sql="""
SELECT type, count(*) AS n FROM loctypes WHERE room_name = '103' GROUP BY 1"""))
def types_in_room(v: Views) -> DataFrame:
    return summaries.types_in_room(v.loctypes, "103")


@query("types_rooms_lookup", with_views("rooms", sql="""
SELECT id, name, floor, count_objects, count_spots FROM rooms WHERE name IN ('103', '106')"""))
def types_rooms_lookup(v: Views) -> DataFrame:
    return summaries.rooms_named(v.rooms, ["103", "106"])


@query("objects_meta", with_views("objects", sql="""
SELECT id AS refers_to_object_id, department_id, is_loan_object FROM objects"""))
def objects_meta(v: Views) -> DataFrame:
    return summaries.objects_meta(v.objects)


# --- graph -----------------------------------------------------------------------------------------

@query("graph_vertices", with_views("vertices", sql="SELECT * FROM vertices"))
def graph_vertices(v: Views) -> DataFrame:
    return v.vertices


@query("journey_pairs", with_views("pairs", sql="SELECT src, dst FROM pairs"))
def journey_pairs(v: Views) -> DataFrame:
    return graph.all_edges(v.tags)


@query("graph_edges", with_views("edges", sql="SELECT src, dst FROM edges"))
def graph_edges(v: Views) -> DataFrame:
    return v.edges


@query("in_degrees", with_views("edges", sql="""
SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1"""))
def in_degrees(v: Views) -> DataFrame:
    return graph.in_degrees(v.edges)


@query("out_degrees", with_views("edges", sql="""
SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY 1"""))
def out_degrees(v: Views) -> DataFrame:
    return graph.out_degrees(v.edges)


@query("degrees", with_views("edges", sql="""
SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
GROUP BY 1"""))
def degrees(v: Views) -> DataFrame:
    return graph.degrees(v.edges)


@query("graph_counts", with_views("vertices", "edges", sql="""
SELECT 'n_vertices' AS metric, count(*) AS value FROM vertices
UNION ALL SELECT 'n_edges', count(*) FROM edges"""))
def graph_counts(v: Views) -> DataFrame:
    return graph.graph_counts(v.vertices, v.edges)


RANKS = pagerank_views("vertices", "edges", PAGERANK_TOL)


def _ranked_sql(sql: str, *views: str) -> str:
    return with_views("vertices", "edges", *views, sql=f"WITH {RANKS}\n{sql}")


def _ranks(v: Views) -> DataFrame:
    return ranking.pagerank(v.vertices, v.edges, tol=PAGERANK_TOL)


@query("pagerank", _ranked_sql("SELECT * REPLACE (round(pagerank, 6) AS pagerank) FROM ranks"))
def pagerank(v: Views) -> DataFrame:
    return _ranks(v)


@query("pagerank_converged", with_views(
    "vertices", "edges", sql=f"WITH {pagerank_views('vertices', 'edges', 1e-5)}\n"
    "SELECT id, round(pagerank, 6) AS pagerank FROM ranks"))
def pagerank_converged(v: Views) -> DataFrame:
    return ranking.pagerank(v.vertices, v.edges, tol=1e-5).select("id", "pagerank")


@query("pagerank_normalized", with_views("pairs", sql="""
WITH ends AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs),
size AS (SELECT count(*) AS n FROM ends),
out_degree AS (SELECT src, count(*) AS d FROM pairs GROUP BY 1),
rank_steps(step, id, pagerank, moved) AS (
  SELECT 0, id, 1.0 / n, CAST(1 AS DOUBLE) FROM ends, size
  UNION ALL
  SELECT s.step + 1, v.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + coalesce(s.loose, 0) / n),
         abs(0.15 / n + 0.85 * (coalesce(g.got, 0) + coalesce(s.loose, 0) / n) - v.pagerank)
  FROM rank_steps v CROSS JOIN size
  JOIN (SELECT max(step) AS step, sum(CASE WHEN o.src IS NULL THEN pagerank END) AS loose,
               sum(moved) AS moved
        FROM rank_steps r LEFT JOIN out_degree o ON o.src = r.id) s ON s.moved >= n * 1e-6
  LEFT JOIN (SELECT e.dst, sum(r.pagerank / o.d) AS got
             FROM rank_steps r JOIN out_degree o ON o.src = r.id JOIN pairs e ON e.src = r.id
             GROUP BY 1) g ON g.dst = v.id)
SELECT id, round(pagerank, 6) AS pagerank FROM rank_steps
WHERE step = (SELECT max(step) FROM rank_steps)"""))
def pagerank_normalized(v: Views) -> DataFrame:
    return ranking.pagerank_normalized(stored(graph.all_edges(v.tags)))


TOP = "(SELECT * FROM ranks ORDER BY round(pagerank, 9) DESC, id LIMIT 10)"
HITS = f"(SELECT c.* FROM calendar c JOIN {TOP} t ON t.id = c.refers_to_object_id)"
BOTTOM = "(SELECT * FROM ranks ORDER BY round(pagerank, 9), id DESC LIMIT 10)"


@query("pagerank_topk", _ranked_sql(
    f"SELECT id, department, type, round(pagerank, 6) AS pagerank FROM {TOP}"))
def pagerank_topk(v: Views) -> DataFrame:
    return ranking.pagerank_topk(_ranks(v))


@query("inspect_pagerank", _ranked_sql(f"""
SELECT l.id, l.type, l.room_id, l.room_name, l.room_floor, l.spot_id, l.spot_name, l.description,
       strftime(l.visit_date, '%Y-%m-%d') AS visit_date, t.department,
       round(t.pagerank, 6) AS pagerank
FROM loctypes l JOIN {TOP} t ON t.id = l.id""", "loctypes"))
def inspect_pagerank(v: Views) -> DataFrame:
    return ranking.inspect_pagerank(v.loctypes, _ranks(v))


def _report_sql(chosen: str) -> str:
    period = "\nUNION ALL\n".join(f"""
SELECT '{p}', CAST({p} AS VARCHAR), CAST(n AS DOUBLE) FROM (
  SELECT {p}, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, {p} LIMIT 5)"""
                                  for p in ranking.PERIODS)
    return _ranked_sql(f"""
SELECT measure, item, round(value, 6) AS value FROM (
WITH hits AS (SELECT f.* FROM featured f JOIN {chosen} t ON t.id = f.refers_to_object_id),
h AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(during_exhibition) AS DOUBLE) AS shown,
             CAST(sum(tagged_after_close) AS DOUBLE) AS late,
             (SELECT CAST(count(*) AS DOUBLE) FROM featured) AS tags FROM hits)
SELECT 'n_tags' AS measure, '' AS item, n AS value FROM h
UNION ALL SELECT 'share_of_tags', '', n / tags FROM h
UNION ALL SELECT 'n_exhibition_tags', '', shown FROM h
UNION ALL SELECT 'exhibition_share_of_influential', '', shown / n FROM h
UNION ALL SELECT 'exhibition_share_of_tags', '', shown / tags FROM h
UNION ALL SELECT 'n_after_close_tags', '', late FROM h
UNION ALL
{period})""", "featured")


@query("influence_report", _report_sql(TOP))
def influence_report(v: Views) -> DataFrame:
    return ranking.influence_report(_ranks(v), v.featured)


@query("influence_report_bottom", _report_sql(BOTTOM))
def influence_report_bottom(v: Views) -> DataFrame:
    return ranking.influence_report(_ranks(v), v.featured, tier="bottom")


@query("influence_activity", _ranked_sql(f"""
SELECT period, position, n_tags,
  CASE period WHEN 'month' THEN ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep',
                                 'Oct', 'Nov', 'Dec'][position]
    WHEN 'dow' THEN ['Mon', 'Tues', 'Wed', 'Thurs', 'Fri', 'Sat', 'Sun'][position + 1]
    WHEN 'hour' THEN CASE WHEN position > 12 THEN CAST(position - 12 AS VARCHAR) || 'pm'
      WHEN position = 12 THEN '12pm' ELSE CAST(position AS VARCHAR) || 'am' END END AS label
FROM (
  SELECT 'month' AS period, month AS position, count(*) AS n_tags FROM {HITS} GROUP BY 2
  UNION ALL SELECT 'dow', dow, count(*) FROM {HITS} GROUP BY 2
  UNION ALL SELECT 'hour', hour, count(*) FROM {HITS} WHERE hour BETWEEN 10 AND 21 GROUP BY 2)
""", "calendar"))
def influence_activity(v: Views) -> DataFrame:
    return ranking.influence_activity(ranking.influential_tags(_ranks(v), v.timed))


def _transitions_sql(near: str, far: str) -> str:
    return _ranked_sql(f"""
SELECT influence_id, influence_type, type, n FROM (
  SELECT t.id AS influence_id, t.type AS influence_type, r.type, count(*) AS n
  FROM edges e JOIN {TOP} t ON t.id = e.{near} JOIN ranks r ON r.id = e.{far} GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY influence_id ORDER BY n DESC, type) <= 10""")


def _transitions(v: Views, direction: str) -> DataFrame:
    listed = ranking.transition_types(_ranks(v), v.edges, direction)
    return listed.select("influence_id", "influence_type", F.explode("transition_types")
                         .alias("t")) \
        .select("influence_id", "influence_type", "t.type", F.col("t.count").alias("n"))


@query("transition_types_in", _transitions_sql("dst", "src"))
def transition_types_in(v: Views) -> DataFrame:
    return _transitions(v, "in")


@query("transition_types_out", _transitions_sql("src", "dst"))
def transition_types_out(v: Views) -> DataFrame:
    return _transitions(v, "out")


LABELS = propagation_views("basket_vertices", "basket_edges", LABEL_ROUNDS)
MAJOR = """
major AS (SELECT id, department, type, loan, label FROM communities WHERE label IN (
  SELECT label FROM communities GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 5))"""


def _labelled_sql(sql: str, *views: str, grid: str = "") -> str:
    return with_views("basket_vertices", "basket_edges", *views, sql=f"WITH {LABELS},\n{MAJOR}{grid}\n{sql}")


def _communities(v: Views, edges: DataFrame | None = None) -> DataFrame:
    return communities.label_propagation(v.basket_vertices, v.basket_edges if edges is None else edges,
                                         max_iter=LABEL_ROUNDS)


def _majority(v: Views, edges: DataFrame | None = None) -> DataFrame:
    return communities.majority_clusters(_communities(v, edges))


@query("label_propagation", _labelled_sql("SELECT * FROM communities"))
def label_propagation(v: Views) -> DataFrame:
    return _communities(v)


@query("majority_clusters", _labelled_sql("SELECT * FROM major"))
def majority_clusters(v: Views) -> DataFrame:
    return _majority(v)


def _register_profiles() -> None:
    by_tag = "FROM featured f JOIN major m ON m.id = f.refers_to_object_id"
    for name, column in (("cluster_exhibitions", "during_exhibition"),
                         ("cluster_after_close", "tagged_after_close")):
        query(name, _labelled_sql(f"""
SELECT m.label, f.{column}, count(*) AS "count" {by_tag} GROUP BY 1, 2""", "featured"))(
            lambda v, column=column: communities.cluster_flag_counts(v.featured, _majority(v),
                                                                     column))
    for name, column, top in (("cluster_loan", "loan", None),
                              ("cluster_departments", "department", None),
                              ("cluster_types", "type", 5)):
        cap = "" if top is None else f"""
QUALIFY row_number() OVER (PARTITION BY label ORDER BY "count" DESC, {column}) <= {top}"""
        query(name, _labelled_sql(f"""
SELECT * FROM (SELECT m.label, m.{column}, count(*) AS "count"
  FROM tags f JOIN major m ON m.id = f.refers_to_object_id GROUP BY 1, 2){cap}""", "tags"))(
            lambda v, column=column, top=top: communities.cluster_attribute_counts(
                v.tags, _majority(v), column, top))


_register_profiles()


@query("cluster_rooms", _labelled_sql("""
SELECT * FROM (SELECT m.label, l.room_name, count(*) AS "count"
  FROM loctypes l JOIN major m ON m.id = l.id GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY "count" DESC, room_name) <= 5""",
                                      "loctypes"))
def cluster_rooms(v: Views) -> DataFrame:
    return communities.cluster_room_counts(v.loctypes, _majority(v))


@query("cluster_type_correlation", _labelled_sql("""
SELECT label, a, b, CASE WHEN isfinite(c) THEN round(c, 6) + 0.0 END AS corr FROM (
  SELECT x.label, x.level AS a, y.level AS b, corr(x.has, y.has) AS c
  FROM grid x JOIN grid y ON y.label = x.label AND y.id = x.id GROUP BY 1, 2, 3)
""", grid=""",
grid AS (
  SELECT m.label, m.id, k.level,
         CASE WHEN k.level IN ('dept_' || m.department, 'type_' || m.type)
              THEN 1.0 ELSE 0.0 END AS has
  FROM major m JOIN (SELECT DISTINCT label, unnest(['dept_' || department, 'type_' || type])
                       AS level FROM major) k ON k.label = m.label)"""))
def cluster_type_correlation(v: Views) -> DataFrame:
    return communities.cluster_type_correlation(_majority(v))


@query("community_subgraph", _labelled_sql("""
SELECT src, dst FROM (
  SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM basket_edges
  WHERE src IN (SELECT id FROM major) OR dst IN (SELECT id FROM major))
WHERE n <= 15"""))
def community_subgraph(v: Views) -> DataFrame:
    edges = stored(v.basket_edges, "basket-edges")
    return communities.community_subgraph(edges, _majority(v, edges))


@query("community_vertices", _labelled_sql("SELECT id, type, label FROM major"))
def community_vertices(v: Views) -> DataFrame:
    return communities.community_vertices(_majority(v))


@query("vertex_reindex", with_views("edges", sql="""
SELECT id, row_number() OVER (ORDER BY id) - 1 AS index
FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""))
def vertex_reindex(v: Views) -> DataFrame:
    return graph.vertex_reindex(v.edges)


@query("reindexed_edges", with_views("edges", sql="""
WITH places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index
  FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))
SELECT a.index AS src, b.index AS dst
FROM edges e JOIN places a ON a.id = e.src JOIN places b ON b.id = e.dst"""))
def reindexed_edges(v: Views) -> DataFrame:
    edges = stored(v.edges)
    return graph.reindexed_edges(edges, graph.vertex_reindex(edges))


REACH = """
WITH near AS (SELECT src, dst FROM basket_edges{back}),
reach AS (SELECT id AS a, id AS b FROM basket_vertices UNION
          SELECT r.a, n.dst FROM reach r JOIN near n ON n.src = r.b)"""


@query("connected_components", with_views("basket_vertices", "basket_edges", sql=REACH.format(
    back=" UNION ALL SELECT dst, src FROM basket_edges") + """
SELECT v.id, v.title, v.type, v.department, c.component
FROM basket_vertices v JOIN (SELECT a, min(b) AS component FROM reach GROUP BY 1) c ON c.a = v.id"""))
def connected_components(v: Views) -> DataFrame:
    return components.connected_components(v.basket_vertices, v.basket_edges) \
        .select("id", "title", "type", "department", "component")


@query("strongly_connected_components", with_views("basket_vertices", "basket_edges", sql=REACH.format(
    back="") + """
SELECT v.id, v.title, v.type, v.department, c.component
FROM basket_vertices v JOIN (SELECT x.a, min(x.b) AS component
  FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1) c ON c.a = v.id"""))
def strongly_connected_components(v: Views) -> DataFrame:
    return components.strongly_connected_components(v.basket_vertices, v.basket_edges) \
        .select("id", "title", "type", "department", "component")


TRIANGLES = """
WITH plain AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b
               FROM {edges} WHERE src <> dst),
closed AS (SELECT x.a, x.b, y.b AS c FROM plain x JOIN plain y ON y.a = x.b
           JOIN plain z ON z.a = x.a AND z.b = y.b)
SELECT v.id, coalesce(t.n, 0) AS "count" FROM {vertices} v LEFT JOIN (
  SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM closed) GROUP BY 1) t
  ON t.id = v.id"""


@query("triangle_count", with_views("vertices", "edges", sql=TRIANGLES.format(
    edges="edges", vertices="vertices")))
def triangle_count(v: Views) -> DataFrame:
    return components.triangle_count(v.vertices.select("id"), v.edges)


# --- a larger graph: parts bought one after the other ------------------------------------------------

@query("basket_edges", with_views("basket_edges", sql="SELECT * FROM basket_edges"))
def basket_edges(v: Views) -> DataFrame:
    return v.basket_edges


BASKET_RANKS = pagerank_views("basket_vertices", "basket_edges", PAGERANK_TOL)


@query("basket_pagerank", with_views(
    "basket_vertices", "basket_edges",
    sql=f"WITH {BASKET_RANKS}\nSELECT id, type, round(pagerank, 6) AS pagerank FROM ranks"))
def basket_pagerank(v: Views) -> DataFrame:
    return ranking.pagerank(v.basket_vertices, v.basket_edges, tol=PAGERANK_TOL) \
        .select("id", "type", "pagerank")


BASKET_LABELS = propagation_views("basket_vertices", "basket_edges", LABEL_ROUNDS)


@query("basket_communities", with_views(
    "basket_vertices", "basket_edges",
    sql=f"WITH {BASKET_LABELS}\nSELECT id, label FROM communities"))
def basket_communities(v: Views) -> DataFrame:
    return communities.label_propagation(v.basket_vertices, v.basket_edges,
                                         max_iter=LABEL_ROUNDS).select("id", "label")


@query("basket_triangles", with_views("basket_vertices", "basket_edges", sql=TRIANGLES.format(
    edges="basket_edges", vertices="basket_vertices")))
def basket_triangles(v: Views) -> DataFrame:
    return components.triangle_count(v.basket_vertices.select("id"), v.basket_edges)


# --- statistics and clustering -------------------------------------------------------------------------

def _vectors(v: Views) -> DataFrame:
    return clustering.from_array(v.embeddings.select("vec_id", "label", "embedding"), "embedding")


def _wide(v: Views) -> DataFrame:
    wide = statistics.vector_columns(v.embeddings.select("vec_id", "label", "embedding"),
                                     "embedding", DIMENSIONS)
    return wide.select(F.col("label").alias("cluster"), *E_COLUMNS)


LONG = """
WITH long AS (SELECT vec_id, label AS cluster, unnest(range(0, 64)) AS i,
                     CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query("pca")
def pca(v: Views) -> DataFrame:
    projected = clustering.pca(_vectors(v), 10).projected
    return projected.select("vec_id", F.posexplode("pca").alias("component", "value")) \
        .withColumn("component", F.col("component") + 1)


@query("scree")
def scree(v: Views) -> DataFrame:
    return clustering.scree(_vectors(v), 50)


@query("kmeans")
def kmeans(v: Views) -> DataFrame:
    """Every row with its cluster, its squared distance from the centroid, and the cluster's size."""
    rows, centres = clustering.kmeans(_vectors(v), "vec_id", 10, starts=100)
    away = F.aggregate(F.zip_with("embedding", "centroid", lambda x, c: (x - c) * (x - c)),
                       F.lit(0.0), lambda a, x: a + x)
    return rows.join(centres, "cluster").select("vec_id", "cluster", "size", away.alias("distance_sq"))


@query("kmeans_centroids")
def kmeans_centroids(v: Views) -> DataFrame:
    centres = clustering.kmeans(_vectors(v), "vec_id", 10, starts=100)[1]
    return centres.select("cluster", "size", F.posexplode("centroid").alias("component", "value"))


@query("kmeans_sweep")
def kmeans_sweep(v: Views) -> DataFrame:
    return clustering.kmeans_sweep(_vectors(v), "vec_id", range(2, 51), starts=SWEEP_STARTS)


@query("bisected_clusters")
def bisected_clusters(v: Views) -> DataFrame:
    return clustering.bisected_clusters(_vectors(v), 10).select("vec_id", "cluster")


# Catalogue profiles: the levels of department and type, and whether an object is on loan.
LEVELS, FLAGS = ["department_id", "type"], ["is_loan_object"]

_LEVEL_ROWS = """
level_rows AS (
  SELECT id, list_filter(['department_id=' || department_id, 'type=' || type,
    CASE WHEN is_loan_object = '1' THEN 'is_loan_object' END], lambda x: x IS NOT NULL) AS levels
  FROM objects),"""

_PROFILES = """
profiles AS (SELECT levels, min(id) AS id, count(*) AS n FROM level_rows GROUP BY levels),
apart AS (
  SELECT a.id AS a, b.id AS b, a.n * b.n AS pairs, len(a.levels) AS la, len(b.levels) AS lb,
         len(list_intersect(a.levels, b.levels)) AS common
  FROM profiles a JOIN profiles b ON a.id < b.id),
measured AS (
  SELECT a, b, pairs, unnest([
    {'metric': 'cityblock', 'distance': CAST(la + lb - 2 * common AS DOUBLE)},
    {'metric': 'cosine', 'distance': 1 - common / sqrt(CAST(la * lb AS DOUBLE))},
    {'metric': 'hamming', 'distance': CAST(la + lb - 2 * common AS DOUBLE)
        / (SELECT count(DISTINCT l) FROM (SELECT unnest(levels) AS l FROM profiles))},
    {'metric': 'jaccard', 'distance': CAST(la + lb - 2 * common AS DOUBLE) / (la + lb - common)}]) AS m
  FROM apart),
distances AS (SELECT m.metric AS metric, a, b, m.distance AS distance, pairs FROM measured)"""

# Merging the nearest two clusters over and over.
_TREE = _PROFILES + """,
tree AS (
  SELECT metric, 0 AS step, a, b, {'d': distance,
         's': (a * 7919 + b * 104729 + a * b % 65521 * 31) % 1000003, 'a': a, 'b': b} AS k,
         pairs, distance * pairs AS total
  FROM distances WHERE metric IN (METRICS)
  UNION ALL
  SELECT metric, step + 1, least(x, y), greatest(x, y), max(k), CAST(sum(pairs) AS BIGINT), sum(total)
  FROM (SELECT t.metric, t.step, t.k, t.pairs, t.total,
               CASE WHEN t.a = m.b THEN m.a ELSE t.a END AS x,
               CASE WHEN t.b = m.b THEN m.a ELSE t.b END AS y
        FROM tree t JOIN (SELECT metric, arg_min(a, k) AS a, arg_min(b, k) AS b FROM tree
                          GROUP BY metric) m ON m.metric = t.metric)
  WHERE x <> y GROUP BY metric, step, least(x, y), greatest(x, y)),
merges AS (
  SELECT metric, step, arg_min(a, k) AS a, arg_min(b, k) AS b, min(k).d AS height,
         arg_min(pairs, k) AS pairs, arg_min(total, k) AS total
  FROM tree GROUP BY metric, step)"""


_CLUSTERS = """
, low AS (SELECT a, b FROM merges WHERE height <= 0.6 * (SELECT max(height) FROM merges)),
climb AS (
  SELECT id, id AS upper FROM profiles
  UNION ALL SELECT c.id, l.a FROM climb c JOIN low l ON l.b = c.upper),
clusters AS (
  SELECT o.id, c.cluster FROM level_rows o JOIN profiles p ON p.levels = o.levels
  JOIN (SELECT id, min(upper) AS cluster FROM climb GROUP BY 1) c ON c.id = p.id)"""


def _tree_sql(body: str, *metrics: str) -> str:
    named = ", ".join(f"'{m}'" for m in metrics or linkage.METRICS)
    return with_views("objects", sql=f"WITH {_LEVEL_ROWS}{_TREE.replace('METRICS', named)}\n{body}")


def _profiled(v: Views) -> tuple[DataFrame, DataFrame]:
    found = stored(linkage.profiles(v.objects, "id", LEVELS, FLAGS), "profiles")
    return found, stored(linkage.profile_pairs(found), "profile-pairs")


@query("profile_distances", with_views("objects", sql=f"""WITH {_LEVEL_ROWS}{_PROFILES}
SELECT metric, a, b, round(distance, 6) AS distance, pairs FROM distances"""))
def profile_distances(v: Views) -> DataFrame:
    return _profiled(v)[1]


@query("linkage_merges", _tree_sql("""
SELECT metric, a, b, round(height, 6) AS height, pairs, round(total, 3) AS total FROM merges"""))
def linkage_merges(v: Views) -> DataFrame:
    return linkage.complete_linkage(_profiled(v)[1]).withColumn("total", F.round("total", 3))


@query("cophenetic_correlation", _tree_sql("""
SELECT metric, round((w * dh - d * h) / sqrt((w * dd - d * d) * (w * hh - h * h)), 6) AS correlation
FROM (SELECT metric, sum(pairs * distance) AS d, sum(pairs * distance * distance) AS dd
      FROM distances GROUP BY 1)
JOIN (SELECT metric, sum(pairs * height) AS h, sum(pairs * height * height) AS hh,
             sum(total * height) AS dh FROM merges GROUP BY 1) USING (metric),
     (SELECT sum(CAST(n AS DOUBLE)) * (sum(CAST(n AS DOUBLE)) - 1) / 2 AS w FROM profiles)"""))
def cophenetic_correlation(v: Views) -> DataFrame:
    found, pairs = _profiled(v)
    return linkage.cophenetic_correlation(found, pairs, linkage.complete_linkage(pairs))


@query("hierarchical_clusters", _tree_sql(_CLUSTERS + " SELECT id, cluster FROM clusters",
                                          "cityblock"))
def hierarchical_clusters(v: Views) -> DataFrame:
    found = stored(linkage.profiles(v.objects, "id", LEVELS, FLAGS), "profiles")
    merges = linkage.complete_linkage(linkage.profile_pairs(found, ["cityblock"]))
    return linkage.row_clusters(v.objects, "id", LEVELS, FLAGS, found,
                                linkage.flat_clusters(found, merges))


@query("object_similarity", with_views("objects", sql="""
SELECT x.id, y.id AS other, round(s.shared / 4.0, 6) AS similarity
FROM objects x JOIN objects y ON x.id <> y.id,
  LATERAL (SELECT CAST(x.department_id = y.department_id AS INT) + CAST(x.type = y.type AS INT)
    + CAST(x.is_loan_object = y.is_loan_object AS INT) + CAST(x.date = y.date AS INT) AS shared) s
WHERE s.shared > 0
QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s.shared DESC, y.id) <= 10"""))
def object_similarity(v: Views) -> DataFrame:
    return metadata.object_similarity(
        v.objects, "id", ["department_id", "type", "is_loan_object", "date"])


@query("sampled_rows", with_views("tags", sql="""
SELECT id, tool_id, bundle_id, refers_to_object_id FROM tags
QUALIFY row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || 'features'))
  <= (SELECT round(count(*) * 0.00275) FROM tags)"""))
def sampled_rows(v: Views) -> DataFrame:
    return selection.sampled_rows(v.tags, "id", fraction=SAMPLED, salt="features") \
        .select("id", "tool_id", "bundle_id", "refers_to_object_id")


@query("temp_view_counts", with_views("tags", sql="""
SELECT tool_id, count(*) AS n, count(DISTINCT bundle_id) AS bundles FROM tags GROUP BY 1"""))
def temp_view_counts(v: Views) -> DataFrame:
    files.register_view(v.tags, "tag_log")
    return v.spark.sql("SELECT tool_id, count(*) AS n, count(DISTINCT bundle_id) AS bundles "
                       "FROM tag_log GROUP BY tool_id")


@query("tool_names", with_views("tags", sql="""
SELECT name, count(*) AS n FROM tags JOIN (VALUES (0, 'wall'), (1, 'purchase'), (2, 'signup'))
  t(tool_id, name) USING (tool_id) GROUP BY 1"""))
def tool_names(v: Views) -> DataFrame:
    names = files.small_table(v.spark, [(0, "wall"), (1, "purchase"), (2, "signup")],
                              "tool_id int, name string")
    return v.tags.join(names, "tool_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("busiest_objects_local", with_views("tags", sql="""
SELECT refers_to_object_id, count(*) AS n FROM tags WHERE refers_to_object_id IS NOT NULL
GROUP BY 1 ORDER BY n DESC, refers_to_object_id LIMIT 10"""))
def busiest_objects_local(v: Views) -> DataFrame:
    """A report of ten rows through the driver and back."""
    local = files.to_local(summaries.top_counts(v.tags, "refers_to_object_id", 10), 10)
    return files.small_table(v.spark, local, "refers_to_object_id long, n long")


@query("feature_group_totals", with_views("binned", sql=f"""
WITH matrix AS ({_matrix_sql()}),
flags AS (UNPIVOT matrix ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE x),
named AS (SELECT feature, x, unnest(list_filter([
    CASE WHEN contains(feature, '_freq') THEN 'turnover' END,
    CASE WHEN contains(feature, '_cap') THEN 'capacity' END,
    CASE WHEN contains(feature, 'floor_') THEN 'floor' END,
    CASE WHEN contains(feature, 'room_') THEN 'room' END,
    CASE WHEN contains(feature, 'quarter_') THEN 'quarter' END,
    CASE WHEN contains(feature, 'month_') THEN 'month' END,
    CASE WHEN contains(feature, 'year_') THEN 'year' END,
    CASE WHEN contains(feature, 'wom_') THEN 'wom' END,
    CASE WHEN feature IN ('Mon', 'Tues', 'Wed', 'Thur', 'Fri', 'weekend') THEN 'days' END,
    CASE WHEN feature IN ('pre-morning', 'morning', 'afternoon', 'evening', 'night',
                          'tagged_after_close') THEN 'time_of_day' END,
    CASE WHEN feature IN ('is_bursty', 'during_exhibition', 'visitor_drawn', 'meta_store')
         THEN 'events' END], lambda g: g IS NOT NULL)) AS name FROM flags)
SELECT name AS "group", feature, CAST(sum(x) AS BIGINT) AS total FROM named GROUP BY 1, 2"""))
def feature_group_totals(v: Views) -> DataFrame:
    """How often each feature of each group is set."""
    matrix = features.feature_matrix(v.modelled)
    columns = [c for c in matrix.columns if c != "id"]
    groups = [(g, c) for g, cs in frames.feature_groups(columns).items() for c in cs]
    sums = matrix.agg(*[F.sum(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(c).alias("feature"),
                                        F.col(f"`{c}`").cast("long").alias("total"))
                               for g, c in groups])).alias("r")
    return sums.select(rows).select("r.*")


@query("projected_clusters")
def projected_clusters(v: Views) -> DataFrame:
    return clustering.projected_clusters(_vectors(v), "vec_id", 10, starts=100) \
        .select("vec_id", "cluster", "x", "y", "centre_x", "centre_y")


@query("cluster_variance", LONG + """
, s AS (SELECT (SELECT sum(n * v) FROM (SELECT count(*) AS n, var_pop(x) AS v FROM long
                                       GROUP BY cluster, i)) AS wcss,
               (SELECT sum(n * v) FROM (SELECT count(*) AS n, var_pop(x) AS v FROM long
                                       GROUP BY i)) AS tss)
SELECT 'wcss' AS measure, round(wcss, 6) AS value FROM s
UNION ALL SELECT 'tss', round(tss, 6) FROM s
UNION ALL SELECT 'bss', round(tss - wcss, 6) FROM s""")
def cluster_variance(v: Views) -> DataFrame:
    return statistics.cluster_variance(_vectors(v).withColumnRenamed("label", "cluster"))


def _register_distances() -> None:
    exact = {
        "cityblock": "list_sum(list_transform(list_zip(x.v, y.v), lambda p: abs(p[1] - p[2])))",
        "cosine": "1 - list_cosine_similarity(x.v, y.v)",
        "hamming": "list_sum(list_transform(list_zip(x.v, y.v), "
                   "lambda p: CASE WHEN p[1] <> p[2] THEN 1.0 ELSE 0.0 END)) / 64",
        "jaccard": "list_sum(list_transform(list_zip(x.v, y.v), "
                   "lambda p: CASE WHEN p[1] <> p[2] THEN 1.0 ELSE 0.0 END)) / "
                   "list_sum(list_transform(list_zip(x.v, y.v), "
                   "lambda p: CASE WHEN p[1] <> 0 OR p[2] <> 0 THEN 1.0 ELSE 0.0 END))",
    }
    for metric, expression in exact.items():
        query(f"pairwise_{metric}", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, round({expression}, 6) AS distance
FROM e x JOIN e y ON x.vec_id <> y.vec_id AND x.vec_id < {REFERENCES}""")(
            # All rows against ten of them.
            lambda v, metric=metric: similarity.reference_distance(
                v.embeddings, "vec_id", "embedding", range(REFERENCES), metric))


_register_distances()


@query("cosine_similarity", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id AS id, y.vec_id AS other,
       round(list_cosine_similarity(x.v, y.v), 6) AS similarity
FROM e x JOIN e y ON x.vec_id <> y.vec_id
QUALIFY row_number() OVER (PARTITION BY x.vec_id
  ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, y.vec_id) <= 10""")
def cosine_similarity(v: Views) -> DataFrame:
    return similarity.cosine_similarity(v.embeddings, "vec_id", "embedding")


@query("target_correlation_vectors", LONG + """
SELECT 'e' || CAST(a.i AS VARCHAR) AS feature, round(corr(a.x, t.x), 6) AS corr
FROM long a JOIN long t ON t.vec_id = a.vec_id AND t.i = 0
GROUP BY a.i ORDER BY round(corr(a.x, t.x), 9) DESC, feature LIMIT 10""")
def target_correlation_vectors(v: Views) -> DataFrame:
    return statistics.target_correlation(_wide(v), "e0", E_COLUMNS)


@query("cluster_target_correlation", LONG + """
SELECT * FROM (
  SELECT a.cluster,
         round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings), 6) AS share,
         'e' || CAST(a.i AS VARCHAR) AS feature, round(corr(a.x, t.x), 6) AS corr
  FROM long a JOIN long t ON t.vec_id = a.vec_id AND t.i = 0 GROUP BY a.cluster, a.i
  QUALIFY row_number() OVER (PARTITION BY a.cluster
    ORDER BY round(corr(a.x, t.x), 9) DESC, 'e' || CAST(a.i AS VARCHAR)) <= 10)""")
def cluster_target_correlation(v: Views) -> DataFrame:
    return statistics.cluster_target_correlation(_wide(v), "e0", E_COLUMNS)


@query("cluster_feature_profile", LONG + """
SELECT cluster, 'e' || CAST(i AS VARCHAR) AS feature, round(avg(x), 6) AS mean
FROM long GROUP BY cluster, i HAVING trunc(avg(x)) <> 1
QUALIFY row_number() OVER (PARTITION BY cluster
  ORDER BY round(avg(x), 9) DESC, 'e' || CAST(i AS VARCHAR)) <= 15""")
def cluster_feature_profile(v: Views) -> DataFrame:
    return statistics.cluster_feature_profile(_wide(v), E_COLUMNS, k=15)


@query("cluster_feature_profile_scaled", LONG + """
, z AS (SELECT cluster, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x
        FROM long WINDOW w AS (PARTITION BY i))
SELECT cluster, 'e' || CAST(i AS VARCHAR) AS feature, round(avg(x), 6) AS mean
FROM z GROUP BY cluster, i HAVING trunc(avg(x)) <> 1
QUALIFY row_number() OVER (PARTITION BY cluster
  ORDER BY round(avg(x), 9) DESC, 'e' || CAST(i AS VARCHAR)) <= 10""")
def cluster_feature_profile_scaled(v: Views) -> DataFrame:
    return statistics.cluster_feature_profile(_wide(v), E_COLUMNS, scale=True)


def _renamed_rooms(v: Views, matrix: DataFrame) -> DataFrame:
    """Room columns named after the rooms."""
    wanted = [int(c[5:]) for c in matrix.columns if c.startswith("room_") and c[5:].isdigit()]
    # One name per room column.
    names = {int(r["id"]): r["name"] for r in
             v.rooms.filter(F.col("id").isin(wanted)).select("id", "name").collect()}
    return matrix.withColumnsRenamed(frames.room_renames(matrix.columns, names))


def _sampled_clusters(v: Views) -> DataFrame:
    """The model chain: feature matrix, sample, linkage, flat clusters, room names."""
    matrix = features.feature_matrix(v.modelled)
    sample = stored(selection.sampled_rows(matrix, "id", fraction=SAMPLED, salt="features"), "sample")
    columns = [c for c in sample.columns if c != "id"]
    found = stored(linkage.profiles(sample, "id", [], columns), "profiles")
    merges = linkage.complete_linkage(linkage.profile_pairs(found, ["cityblock"]))
    clusters = linkage.row_clusters(sample, "id", [], columns, found,
                                    linkage.flat_clusters(found, merges))
    return stored(_renamed_rooms(v, sample.join(clusters, "id").drop("id")), "clustered")


def _sampled_sql(body: str) -> str:
    return with_views("binned", "rooms", sql=f"""
WITH matrix AS ({_matrix_sql()}),
sample AS (SELECT * FROM matrix QUALIFY row_number() OVER (
    ORDER BY md5(CAST(id AS VARCHAR) || 'features')) <= (SELECT round(count(*) * {SAMPLED}) FROM matrix)),
flags AS (UNPIVOT sample ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE x),
level_rows AS (SELECT id, coalesce(list(feature ORDER BY feature) FILTER (WHERE x = 1), []) AS levels
               FROM flags GROUP BY id),
{_TREE.replace("METRICS", "'cityblock'")}{_CLUSTERS},
named AS (
  SELECT c.cluster, coalesce('rm_' || r.name, f.feature) AS feature, f.x, t.x AS t
  FROM flags f JOIN clusters c ON c.id = f.id
  JOIN flags t ON t.id = f.id AND t.feature = 'during_exhibition'
  LEFT JOIN rooms r ON f.feature = 'room_' || CAST(r.id AS VARCHAR))
{body}""")


@query("sample_cluster_correlation", _sampled_sql("""
SELECT cluster, round(n / (SELECT CAST(count(*) AS DOUBLE) FROM sample), 6) AS share, feature,
       round(c, 6) AS corr
FROM (SELECT cluster, feature, count(*) AS n,
             CASE WHEN isfinite(corr(x, t)) THEN corr(x, t) END AS c FROM named GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(round(c, 9), -2) DESC, feature)
  <= 10"""))
def sample_cluster_correlation(v: Views) -> DataFrame:
    rows = _sampled_clusters(v)
    columns = [c for c in rows.columns if c != "cluster"]
    return statistics.cluster_target_correlation(rows, "during_exhibition", columns)


@query("sample_cluster_profile", _sampled_sql("""
SELECT cluster, feature, round(avg(x), 6) AS mean FROM named GROUP BY cluster, feature
HAVING trunc(avg(x)) <> 1
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(avg(x), 9) DESC, feature) <= 15"""))
def sample_cluster_profile(v: Views) -> DataFrame:
    rows = _sampled_clusters(v)
    columns = [c for c in rows.columns if c != "cluster"]
    return statistics.cluster_feature_profile(rows, columns, k=15)


@query("target_correlation", with_views("binned", "rooms", sql=f"""
WITH matrix AS ({_matrix_sql()}),
flags AS (UNPIVOT matrix ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE x),
named AS (SELECT coalesce('rm_' || r.name, feature) AS feature, x, during_exhibition AS t
  FROM flags f JOIN featured d ON d.id = f.id
  LEFT JOIN rooms r ON feature = 'room_' || CAST(r.id AS VARCHAR))
SELECT feature, CASE WHEN isfinite(c) THEN round(c, 6) END AS corr FROM (
  SELECT feature, corr(x, t) AS c FROM named GROUP BY 1)
ORDER BY CASE WHEN isfinite(c) THEN round(c, 9) ELSE -2 END DESC, feature LIMIT 10"""))
def target_correlation(v: Views) -> DataFrame:
    found = statistics.level_correlation(features.level_sets(v.modelled), "during_exhibition")
    room = v.rooms.select(F.concat(F.lit("room_"), F.col("id").cast("string")).alias("level"),
                          F.concat(F.lit("rm_"), "name").alias("named"))
    return found.join(room, "level", "left") \
        .select(F.coalesce("named", "level").alias("feature"), "corr") \
        .orderBy(F.desc_nulls_last(F.round("corr", 9)), "feature").limit(10)


@query("feature_codes", with_views("binned", sql=f"""
WITH matrix AS ({_matrix_sql()}),
flags AS (UNPIVOT matrix ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE x),
used AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS index
         FROM (SELECT DISTINCT feature FROM flags WHERE x = 1))
SELECT id, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS indices,
       string_agg(feature, ',' ORDER BY index) AS levels
FROM flags JOIN used USING (feature) WHERE x = 1 GROUP BY 1"""))
def feature_codes(v: Views) -> DataFrame:
    """Sparse vectors of the feature matrix, and what they unpack to."""
    sets = stored(features.level_sets(v.modelled), "level-sets")
    numbered = stored(features.dictionary(sets), "dictionary")
    codes = stored(features.coded(sets, numbered), "codes")
    # Each distinct vector is unpacked once; rows then meet what theirs says.
    vectors = codes.select("indices").distinct()
    words = stored(features.decoded(vectors, numbered, "indices").groupBy("indices")
                   .agg(F.collect_list("level").alias("words")), "words")
    names = lookup_join(codes, words, ["indices"], "inner").groupBy("id") \
        .agg(F.array_join(F.array_sort(F.flatten(F.collect_list("words"))), ",").alias("levels"))
    return codes.join(names, "id").select("id", F.array_join("indices", ",").alias("indices"), "levels")


@query("hour_labels", with_views("calendar", sql="""
SELECT DISTINCT hour, CASE WHEN hour > 12 THEN CAST(hour - 12 AS VARCHAR) || 'pm'
  WHEN hour = 12 THEN '12pm' ELSE CAST(hour AS VARCHAR) || 'am' END AS label,
  CASE WHEN hour > 0 AND hour <= 10 THEN 'pre-morning' WHEN hour > 10 AND hour <= 12 THEN 'morning'
    WHEN hour > 12 AND hour <= 17 THEN 'afternoon' WHEN hour > 17 AND hour <= 20 THEN 'evening'
    WHEN hour > 20 THEN 'night' END AS bin FROM calendar"""))
def hour_labels(v: Views) -> DataFrame:
    return times.tag_time_features(v.tags).select("hour").distinct() \
        .withColumns({"label": labels.hour_label(F.col("hour")),
                      "bin": binning.hour_bin(F.col("hour"))})
