"""Readers of the given tables and of the trail-shaped views over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway import skew
from cairnway.functions import geo, text
from cairnway.sources.views import SHARED

# The views round a double as its scaled value; Spark's round(x, n) goes by its decimal digits,
# which differs on ties such as 66.725.
_ROUND = re.compile(r"round\(((?:[^()]|\([^()]*\))*), (\d)\)")


def _scaled_rounds(sql: str) -> str:
    return _ROUND.sub(r"(round((\1) * 1e\2) / 1e\2)", sql)


LINE_ORDER = ["s1", "s2", "s3", "s4", "s5"]


class Tables:
    """Lazy access to one folder of parquet tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Plans are lazy values, so a part used twice in one query is described once."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def raw(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self.once(path, lambda: self.spark.read.parquet(path))

    def view(self, name: str) -> DataFrame:
        def build() -> DataFrame:
            sql = _scaled_rounds(SHARED[name])
            sources = {source: self.raw(source) for source in set(re.findall(r"\{(\w+)\}", sql))}
            return self.spark.sql(sql, **sources)

        return self.once(name, build)

    # -- lines -------------------------------------------------------------

    def line_width(self) -> int | None:
        """Rows of the longest line, which no part of one exceeds; nothing if a task can't hold it."""
        width = skew.widest(self.view("v_points"), ["feature_id"])
        return width if width <= skew.TASK_ROWS else None

    def vertices(self) -> DataFrame:
        """feature_id, part, pos (1-based inside the part), lon, lat, elevation_m."""

        def build() -> DataFrame:
            points, width = self.view("v_points"), self.line_width()
            if width is not None:
                # Whole lines lie in one partition, so work by part and by line shares one shuffle. The rows
                # travel as given; places and heights are made behind the shuffle.
                points = self.spark.sql(_scaled_rounds(SHARED["v_points"]), lineitem=self.raw("lineitem").repartition("l_orderkey"))
            return skew.position(
                points, ["feature_id", "part"], [F.col(c) for c in LINE_ORDER], "pos", width=width
            ).select("feature_id", "part", "pos", "lon", "lat", "elevation_m")

        return self.once("vertices", build)

    def segments(self) -> DataFrame:
        """Consecutive vertices of a part; a gap between parts is never a segment."""
        return self.once(
            "segments",
            lambda: skew.with_neighbours(
                self.vertices(),
                ["feature_id", "part"],
                "pos",
                following={"lon": "lon2", "lat": "lat2", "elevation_m": "elevation2"},
                width=self.line_width(),
            ).where(F.col("lon2").isNotNull()),
        )

    def measured_segments(self) -> DataFrame:
        return self.segments().withColumn(
            "km",
            geo.great_circle_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")),
        )

    # -- features ----------------------------------------------------------

    def ways(self) -> DataFrame:
        """Ways with a usable id; ids must be positive."""
        return self.view("v_ways").where(F.col("way_id") > 0)

    def dealt_ways(self) -> DataFrame:
        """The same, dealt to several tasks before names and tags are made, for work that is dear per way."""

        def build() -> DataFrame:
            tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
            orders = self.raw("orders").repartition(tasks, "o_orderkey")
            return self.spark.sql(_scaled_rounds(SHARED["v_ways"]), orders=orders).where(F.col("way_id") > 0)

        return self.once("dealt", build)

    def keyed_ways(self) -> DataFrame:
        return self.ways().withColumn("name_key", text.name_key("name"))

    def relations(self) -> DataFrame:
        return self.view("v_relations").where(F.col("relation_id") > 0)

    def members(self) -> DataFrame:
        """relation_id, pos, member_type, ref, role; rows without a usable ref are dropped."""
        rows = self.view("v_member_rows").where(F.col("ref") > 0)
        return skew.position(
            rows, ["relation_id"], [F.col("s1"), F.col("ref")], "pos"
        ).select(
            "relation_id",
            "pos",
            F.upper("raw_type").alias("member_type"),
            "ref",
            F.lower("role").alias("role"),
        )

    def listed(self) -> DataFrame:
        """relation_id, member_type, ref: members without their place, which takes a count and a sort of all of them."""
        return self.view("v_member_rows").where(F.col("ref") > 0).select("relation_id", F.upper("raw_type").alias("member_type"), "ref")

    def places(self) -> DataFrame:
        return self.view("v_places")

    def hourly(self) -> DataFrame:
        """Hourly readings; ``ts`` is local time without a zone."""
        return self.view("v_hourly").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def sample(self) -> DataFrame:
        """Ways as the difficulty dataset sees them: tier, cell and raw tags."""
        tier = F.lit(None).cast("string")
        for grade, name in lx.GRADE_TIER.items():
            tier = F.when(F.col("sac_scale") == grade, name).otherwise(tier)
        return self.ways().select(
            F.col("way_id").alias("feature_id"),
            "sac_scale",
            tier.alias("tier"),
            "length_km",
            "latitude",
            "longitude",
            geo.cell(F.col("longitude"), 1.0).alias("grid_x"),
            geo.cell(F.col("latitude"), 1.0).alias("grid_y"),
            *[c for c in lx.CENSUS_TAGS],
        )
