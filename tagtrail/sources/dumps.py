"""Catalogue records from dumped response pages.

A dump is a folder of JSON lines, a page on each: the record list of one page with the declared
total. With ``whole_files`` each file is one page. Every reader knows its schema, so a dump is
scanned once and a page without records changes no type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from .files import read_json, read_json_records


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def page_records(spark: SparkSession, folder: str, field: str, schema: StructType | None = None,
                 whole_files: bool = False) -> DataFrame:
    return read_json_records(spark, folder, field, schema, whole_files)


def page_completeness(spark: SparkSession, folder: str, field: str,
                      schema: StructType | None = None, whole_files: bool = False) -> DataFrame:
    """(found, total, complete): records found against the total the pages declare."""
    pages = read_json(spark, folder, schema, whole_files)
    found = F.coalesce(F.sum(F.greatest(F.size(field), F.lit(0)).cast("long")), F.lit(0))
    return pages.agg(found.alias("found"), F.max(F.col("total").cast("long")).alias("total")) \
        .withColumn("complete", F.col("found") == F.col("total"))


def site_summary(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """Figures of the site with the smallest id that the pages list."""
    sites = page_records(spark, folder, "sites.site", schemas.SITE_PAGES, whole_files)
    first = sites.agg(F.min_by(F.struct(*sites.columns), F.col("id").cast("long")).alias("s"))
    return _long(first.where("s IS NOT NULL").select("s.*"),
                 "count_objects", "count_rooms", "count_spots")


def site_objects(spark: SparkSession, folder: str, schema: StructType = schemas.OBJECT_PAGES,
                 whole_files: bool = False) -> DataFrame:
    records = page_records(spark, folder, "objects", schema, whole_files)
    return _long(records, "id")


def site_departments(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    return page_records(spark, folder, "departments", schemas.DEPARTMENT_PAGES, whole_files)


def site_exhibitions(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    return page_records(spark, folder, "exhibitions", schemas.EXHIBITION_PAGES, whole_files)


def site_rooms(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    rooms = page_records(spark, folder, "rooms.room", schemas.ROOM_PAGES, whole_files)
    return _long(rooms, "floor", "count_objects", "count_spots")


def site_spots(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    return _long(page_records(spark, folder, "spots.spot", schemas.SPOT_PAGES, whole_files),
                 "count_objects")


def site_types(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    return page_records(spark, folder, "types", schemas.TYPE_PAGES, whole_files)


def exhibition_documents(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """Documents (``_id``, ``objects``) of exhibitions that list objects. A page names its
    exhibition in ``exhibition_id``; an exhibition of several pages has a document for each, so
    a large one is never gathered in one row."""
    pages = read_json(spark, folder, schemas.MEMBER_PAGES, whole_files)
    return pages.filter(F.size("objects") > 0) \
        .select(F.col("exhibition_id").alias("_id"), "objects")
