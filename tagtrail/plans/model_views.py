"""The museum model over the star-schema test tables.

Each view reads the parquet tables of one scale directory: ``events`` gives the tag log, ``part``
the catalogue, ``lineitem`` with its supplier, nation and region the location visits.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import exhibitions, graph, journeys, locations, times
from ..scale.durable import stored
from ..scale.skew import lookup_join

# 2024-01-01 as epoch seconds: visits are moved into the month of the tag log.
VISIT_START = 1_704_067_200


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # --- raw model ---------------------------------------------------------------------------

    @cached_property
    def tags(self) -> DataFrame:
        seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"),
                                   F.col("ts").cast("timestamp_ntz"))
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(0).alias("tool_id"),
            F.col("user_id").cast("string").alias("bundle_id"),
            F.get_json_object("props", "$.k").cast("long").alias("refers_to_object_id"),
            seconds.alias("created"))

    @cached_property
    def departments(self) -> DataFrame:
        return self.table("part") \
            .select(F.col("p_brand").alias("id"),
                    F.concat(F.lit("Dept "), "p_brand").alias("name")).distinct()

    @cached_property
    def objects(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
            (size + 1900).cast("string").alias("date"), F.col("p_brand").alias("department_id"),
            F.col("p_type").alias("type"), F.col("p_type").alias("type_id"),
            (size % 2).cast("string").alias("is_loan_object"))

    @cached_property
    def places(self) -> DataFrame:
        return self.table("supplier") \
            .join(self.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")) \
            .join(self.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))

    @staticmethod
    def _spot_name() -> Column:
        return F.concat(F.lit("Floor "), (F.col("r_regionkey") + 1).cast("string"), F.lit(", "),
                        (F.col("n_nationkey") + 100).cast("string"), F.lit(", Spot "),
                        F.col("s_suppkey").cast("string"))

    @cached_property
    def visits(self) -> DataFrame:
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
        number = (F.col("n_nationkey") + 100).cast("string")
        floor = F.col("r_regionkey") + 1
        return self.table("lineitem") \
            .join(self.places, F.col("s_suppkey") == F.col("l_suppkey")).select(
                F.col("l_partkey").alias("refers_to_object_id"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("location_id"),
                ((day % 30).cast("long") * 86400 + VISIT_START).alias("visit_raw"),
                floor.alias("room_floor"), F.col("n_nationkey").alias("room_id"),
                number.alias("room_name"), F.col("s_suppkey").alias("spot_id"),
                self._spot_name().alias("spot_name"),
                F.col("s_name").alias("spot_description"))

    @staticmethod
    def _rooms(visits: DataFrame) -> DataFrame:
        return visits.groupBy(F.col("room_id").alias("id"), F.col("room_name").alias("name"),
                              F.col("room_floor").alias("floor")) \
            .agg(F.count_distinct("refers_to_object_id").alias("count_objects"),
                 F.count_distinct("spot_id").alias("count_spots"))

    @staticmethod
    def _spots(visits: DataFrame) -> DataFrame:
        return visits.groupBy(F.col("spot_id").alias("id"), F.col("spot_name").alias("name"),
                              F.col("spot_description").alias("description")) \
            .agg(F.count_distinct("refers_to_object_id").alias("count_objects"))

    @cached_property
    def rooms(self) -> DataFrame:
        return self._rooms(self.visits)

    @cached_property
    def spots(self) -> DataFrame:
        """As ``_spots`` of the visits: each place of a supplier has all lines of that supplier, so
        objects are counted on two keys, before names are joined."""
        counted = self.table("lineitem").groupBy(F.col("l_suppkey").alias("id")) \
            .agg(F.count_distinct("l_partkey").alias("count_objects"))
        named = self.places.select(
            F.col("s_suppkey").alias("id"), self._spot_name().alias("name"),
            F.col("s_name").alias("description")).distinct()
        return lookup_join(named, counted, ["id"], "inner") \
            .select("id", "name", "description", "count_objects")

    @cached_property
    def locations(self) -> DataFrame:
        """Visits with the counts of their room and spot: three readings of one written table."""
        visits = stored(self.visits, "visits")
        rooms = self._rooms(visits).select(F.col("id").alias("room_id"),
                                           F.col("count_objects").alias("room_count_objects"),
                                           F.col("count_spots").alias("room_count_spots"))
        spots = self._spots(visits).select(F.col("id").alias("spot_id"),
                                           F.col("count_objects").alias("spot_count_objects"))
        located = lookup_join(visits, rooms, ["room_id"], "inner")
        return lookup_join(located, spots, ["spot_id"], "inner")

    @cached_property
    def dated_visits(self) -> DataFrame:
        return self.visits.withColumn("visit_date", cal.utc_date(F.col("visit_raw")))

    @cached_property
    def nested_objects(self) -> DataFrame:
        """Catalogue rows with the visit as a nested struct, one per visit."""
        return self.visits.select(
            F.col("refers_to_object_id").alias("id"),
            F.struct(F.col("location_id").alias("id"), F.col("visit_raw").alias("visit_time"),
                     F.struct(F.col("room_id").alias("id"), F.col("room_name").alias("name"),
                              F.col("room_floor").alias("floor")).alias("room"),
                     F.struct(F.col("spot_id").alias("id"), F.col("spot_name").alias("name"),
                              F.col("spot_description").alias("description"),
                              F.col("room_id").alias("room_id")).alias("spot"))
            .alias("location_visit"))

    @cached_property
    def exhibitions(self) -> DataFrame:
        part = self.table("part")
        number = F.substring("p_brand", 7, 9).cast("int")

        def day(start: int):
            return F.concat(F.lit("2024-01-"),
                            F.lpad((start + number % 20).cast("string"), 2, "0"))

        branded = part.select("p_brand").distinct().select(
            number.cast("string").alias("id"), day(1).alias("date_start"),
            F.when(F.col("p_brand") == "Brand#25", "0000-00-00").otherwise(day(11))
            .alias("date_end"), number.alias("ordinal"))
        typed = part.filter(F.col("p_type").isin("PROMO", "STANDARD")).select("p_type") \
            .distinct().select((F.length("p_type") + 100).cast("string").alias("id"),
                               F.lit("2024-01-05").alias("date_start"),
                               F.lit("2024-01-25").alias("date_end"),
                               (F.length("p_type") + 100).alias("ordinal"))
        return branded.unionByName(typed)

    @cached_property
    def exhibition_members(self) -> DataFrame:
        part = self.table("part")
        key = F.col("p_partkey").alias("object_id")
        branded = part.select(F.substring("p_brand", 7, 9).alias("exhibition_id"), key)
        typed = part.filter(F.col("p_type").isin("PROMO", "STANDARD")) \
            .select((F.length("p_type") + 100).cast("string").alias("exhibition_id"), key)
        return branded.unionByName(typed)

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    # --- derived ------------------------------------------------------------------------------

    @cached_property
    def timed(self) -> DataFrame:
        return times.closing_time_flag(times.tag_time_features(self.tags))

    @cached_property
    def featured(self) -> DataFrame:
        """Tags with time features and both flags."""
        return exhibitions.during_exhibition(
            self.timed, exhibitions.exhibitions_clean(self.exhibitions),
            self.exhibition_members)

    @cached_property
    def located(self) -> DataFrame:
        return locations.nearest_location(self.featured, self.locations, base=self.tags)

    @cached_property
    def journey_keys(self) -> DataFrame:
        return self.tags.select("bundle_id",
                                cal.local_date(F.col("created")).alias("created_date_est"))

    @cached_property
    def modelled(self) -> DataFrame:
        """Located tags with burst counts: the input of the feature matrix, which reads it more
        than once, so it is kept as a stage snapshot."""
        return stored(journeys.bursty_tags(self.located, journeys.burst_anomalies(self.tags)),
                      "located-tags")

    @cached_property
    def loctypes(self) -> DataFrame:
        return locations.object_loctypes(self.objects, self.dated_visits)

    @cached_property
    def vertices(self) -> DataFrame:
        return stored(graph.graph_vertices(self.tags, self.objects, self.departments), "vertices")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.graph_edges(graph.all_edges(self.tags), self.vertices)

    @cached_property
    def baskets(self) -> DataFrame:
        """A larger tag log: order lines as tags of parts by customers, a minute apart. Vertices and
        edges both read it, so it is written. Bundles stay numbers, which only group the tags."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
        return stored(lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.lit(0).alias("tool_id"), F.col("o_custkey").alias("bundle_id"),
            F.col("l_partkey").alias("refers_to_object_id"),
            (day.cast("long") * 86400 + F.col("l_linenumber") * 60).alias("created")), "baskets")

    @cached_property
    def basket_vertices(self) -> DataFrame:
        return stored(graph.graph_vertices(self.baskets, self.objects, self.departments),
                      "basket-vertices")

    @cached_property
    def basket_edges(self) -> DataFrame:
        return graph.graph_edges(graph.all_edges(self.baskets, written=True), self.basket_vertices, known=True)
