"""The retail panel, prices and calendar, derived from order-line tables.

item = brand, store = supplier nation, state = region, day = ship date.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_ONE = "1995-01-02"
SERIES = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]

# Fixed values: (month, day, event name, event type).
EVENTS = [
    (1, 1, "NewYear", "National"),
    (2, 14, "Valentine", "Cultural"),
    (7, 4, "Independence", "National"),
    (12, 25, "Christmas", "Religious"),
]
SNAP_STATES = ["AFRICA", "AMERICA", "ASIA"]


def day_to_date(day: Column) -> Column:
    return F.date_add(F.lit(DAY_ONE).cast("date"), day - 1)


def ship_day() -> Column:
    return (F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY_ONE).cast("date")) + 1).alias("d")


class Retail:
    """Lazy views over one folder of tables. Every view is an unexecuted plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def stores(self) -> DataFrame:
        region = self.table("region")
        return (
            self.table("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Observed daily sales per series.

        Order lines are summed by item, store key and day before names and parents are
        attached, so the shuffle carries narrow rows and partial sums absorb hot items.
        """
        line = self.table("lineitem").select(
            "l_partkey",
            "l_suppkey",
            ship_day(),
            "l_quantity",
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        )
        items = self.table("part").select("p_partkey", F.col("p_brand").alias("item_id"))
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        number = F.substring("item_id", 7, 10).cast("int")
        return (
            line.join(items, F.col("l_partkey") == F.col("p_partkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("item_id", "s_nationkey", "d")
            .agg(F.sum("l_quantity").alias("sales"), F.sum("c").alias("cents"))
            .join(self.stores, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat_ws("_", "item_id", "store_id").alias("id"),
                "item_id",
                F.concat(F.lit("D"), number % 3, F.lit("_"), number % 2).alias("dept_id"),
                F.concat(F.lit("C"), number % 3).alias("cat_id"),
                "store_id",
                "state_id",
                "d",
                "sales",
                "cents",
            )
        )

    @cached_property
    def staged(self) -> Retail:
        """The same views over a panel that is written once: for queries that read it several times."""
        from tidegrid.sources.files import checkpoint_table

        stored = Retail(self.spark, self.folder)
        panel = checkpoint_table(self.panel, "panel")
        stored.__dict__["panel"] = panel
        stored.__dict__["last_day"] = panel.agg(F.max("d")).scalar()
        stored.__dict__["staged"] = stored
        return stored

    @cached_property
    def last_day(self) -> Column:
        """Scalar subquery: last day with a sale anywhere."""
        return self.table("lineitem").select(ship_day()).agg(F.max("d")).scalar()

    @cached_property
    def grid(self) -> DataFrame:
        """Item x store grid, gap-free from first sale to the last day."""
        from tidegrid.operators.reshape import fill_gaps

        return fill_gaps(self.panel, SERIES, "d", {"sales": 0.0, "cents": 0}, end=self.last_day)

    def grid_between(self, after: Column, upto: Column) -> DataFrame:
        """The grid's days in (after, upto]; earlier days are never generated."""
        from tidegrid.operators.reshape import fill_gaps

        past = self.panel.filter(F.col("d") <= upto)
        return fill_gaps(past, SERIES, "d", {"sales": 0.0, "cents": 0}, end=upto, start=after + 1)

    @cached_property
    def dept_panel(self) -> DataFrame:
        """Observed daily sales per department x store."""
        return (
            self.panel.groupBy("dept_id", "cat_id", "store_id", "state_id", "d")
            .agg(F.sum("sales").alias("sales"), F.sum("cents").alias("cents"))
            .withColumn("id", F.concat_ws("_", "dept_id", "store_id"))
        )

    @cached_property
    def dept_grid(self) -> DataFrame:
        from tidegrid.operators.reshape import fill_gaps

        keys = ["id", "dept_id", "cat_id", "store_id", "state_id"]
        return fill_gaps(self.dept_panel, keys, "d", {"sales": 0.0, "cents": 0}, end=self.last_day)

    @cached_property
    def prices(self) -> DataFrame:
        """Weekly price per store and item."""
        return (
            self.panel.groupBy("store_id", "item_id", F.expr("(d - 1) div 7").cast("int").alias("wm_yr_wk"))
            .agg((F.sum("cents") / F.lit(100.0) / F.sum("sales")).alias("sell_price"))
        )

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per day up to the last day: weeks, parts, events, state flags."""
        days = self.spark.range(1).select(F.explode(F.sequence(F.lit(1), self.last_day)).alias("d"))
        date = day_to_date(F.col("d"))
        name = F.lit(None).cast("string")
        kind = F.lit(None).cast("string")
        for month, day, event, event_type in EVENTS:
            hit = (F.month("date") == month) & (F.dayofmonth("date") == day)
            name = F.when(hit, F.lit(event)).otherwise(name)
            kind = F.when(hit, F.lit(event_type)).otherwise(kind)
        flags = [
            (F.pmod(F.dayofmonth("date") + shift, F.lit(3)) == 0).cast("int").alias(f"snap_{state}")
            for shift, state in enumerate(SNAP_STATES)
        ]
        return days.withColumn("date", date).select(
            "d",
            "date",
            F.expr("(d - 1) div 7").cast("int").alias("wm_yr_wk"),
            (F.weekday("date") + 1).alias("wday"),
            F.month("date").alias("month"),
            F.year("date").alias("year"),
            name.alias("event_name_1"),
            kind.alias("event_type_1"),
            F.when((F.month("date") == 7) & (F.dayofmonth("date") == 4), F.lit("Summer")).alias("event_name_2"),
            F.when((F.month("date") == 7) & (F.dayofmonth("date") == 4), F.lit("Cultural")).alias("event_type_2"),
            *flags,
        )


def by_series(order: str = "d", key: str | list[str] = "id") -> Window:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)
