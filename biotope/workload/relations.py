"""Base relations of the workload: one Spark builder and one SQL text each.

Counts and sums run on whole numbers (cents, percent points), so both sides give
the same bits whatever the order of addition. Units are scaled by divisors without
finite decimals, which keeps later means off the exact halves of a rounding step.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biotope.functions.calendar import week_start
from biotope.functions.weather import grid_key
from biotope.session import materialize
from biotope.sources.gridded import hourly_grid

CELLS = ("click", "error", "purchase", "signup", "view")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Land-cover codes given to the pixels, and three site outlines (the second has a
# hole, the third two parts) in the plane of the pixels.
PIXEL_CODES = (311, 312, 231, 324, 112, 411, 512, 0)
PIXEL_TILE = 0.1
SITE_RINGS = (
    ("1", 1, (((-0.30, -0.30), (0.02, -0.30), (0.02, 0.30), (-0.30, 0.20), (-0.30, -0.30)),)),
    (
        "2",
        1,
        (
            ((0.02, -0.30), (0.30, -0.25), (0.35, 0.30), (0.02, 0.30), (0.02, -0.30)),
            ((0.08, -0.05), (0.15, -0.05), (0.15, 0.08), (0.08, 0.08), (0.08, -0.05)),
        ),
    ),
    ("3", 1, (((-0.10, 0.31), (0.10, 0.31), (0.00, 0.45), (-0.10, 0.31)),)),
    ("3", 2, (((-0.42, -0.40), (-0.20, -0.40), (-0.30, -0.31), (-0.42, -0.40)),)),
)


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("bigint")


def _ring_rows() -> str:
    rows = []
    for site, part, rings in SITE_RINGS:
        for ring_no, ring in enumerate(rings):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                rows.append(f"('{site}', {part}, {ring_no}, {x1}, {y1}, {x2}, {y2})")
    return ", ".join(rows)


class Tables:
    """The test tables of one folder and the relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str) -> DataFrame:
        """The named relation written once, for queries that read it more than once.

        Left to the optimizer, its two readers would ask for different columns and
        the join below it would run twice.
        """
        if name not in self._written:
            self._written[name] = materialize(getattr(self, name), name)
        return self._written[name]

    @cached_property
    def order_sites(self) -> DataFrame:
        orders, customer = self.table("orders"), self.table("customer")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            "o_orderkey",
            F.col("c_nationkey").cast("string").alias("site"),
            F.to_date("o_orderdate").alias("order_day"),
            "o_totalprice",
            "o_orderpriority",
            "o_orderstatus",
        )

    @cached_property
    def site_week(self) -> DataFrame:
        line = self.table("lineitem")
        joined = line.join(self.order_sites.select("o_orderkey", "site"), line.l_orderkey == F.col("o_orderkey"))
        return joined.groupBy("site", week_start(F.to_date("l_shipdate")).alias("week_start")).agg(
            F.count(F.lit(1)).alias("line_count"),
            F.count_if(F.col("l_returnflag") == "R").alias("cases_a"),
            F.count_if(F.col("l_returnflag") == "A").alias("cases_b"),
            (F.avg("l_quantity") / 0.99).alias("temp_mean"),
            F.min("l_quantity").alias("temp_min"),
            F.max("l_quantity").alias("temp_max"),
            (F.sum(cents(F.col("l_discount"))).cast("double") / F.count(F.lit(1)) / 0.099).alias("humid_mean"),
            (F.sum(cents(F.col("l_extendedprice"))).cast("double") / 990000).alias("rain_sum"),
        )

    @cached_property
    def yearly_site(self) -> DataFrame:
        """Two-year census rounds, dated by the even year that closes them."""
        year = F.year("order_day")
        census = (year + F.pmod(year, F.lit(2))).alias("year")
        return self.order_sites.groupBy("site", census).agg(
            (F.count(F.lit(1)) * 1000).alias("population"),
            (F.sum(cents(F.col("o_totalprice"))).cast("double") / F.count(F.lit(1)) / 99000).alias("density"),
        )

    @cached_property
    def static_site(self) -> DataFrame:
        nation, region, supplier = self.table("nation"), self.table("region"), self.table("supplier")
        relief = supplier.groupBy("s_nationkey").agg(
            F.count(F.lit(1)).alias("stations"),
            (F.sum(cents(F.col("s_acctbal"))).cast("double") / F.count(F.lit(1)) / 990).alias("elevation_mean"),
            ((F.max(cents(F.col("s_acctbal"))) - F.min(cents(F.col("s_acctbal")))).cast("double") / 1000).alias(
                "elevation_range"
            ),
        )
        return (
            nation.join(region, nation.n_regionkey == region.r_regionkey)
            .join(relief, nation.n_nationkey == relief.s_nationkey, "left")
            .select(
                F.col("n_nationkey").cast("string").alias("site"),
                F.col("n_name").alias("site_name"),
                F.col("r_name").alias("region_name"),
                "stations",
                "elevation_mean",
                "elevation_range",
            )
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Events averaged to one row per hour and cell, as gridded weather."""
        value = cents(F.col("value"))
        events = self.table("events").select(
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"),
            F.array_position(F.array(*[F.lit(c) for c in CELLS]), F.col("event_type")).cast("int").alias("cell_no"),
            value.alias("v"),
            F.pmod(value * 7, F.lit(10000)).alias("h"),
            F.pmod(value, F.lit(300)).alias("r"),
        )
        means = events.groupBy("time", "cell_no").agg(F.avg("v").alias("v"), F.avg("h").alias("h"), F.avg("r").alias("r"))
        grid = means.select(
            "time",
            "cell_no",
            (F.lit(45) + F.col("cell_no") / 10).alias("latitude"),
            (F.lit(13) + F.col("cell_no") / 8).alias("longitude"),
            (F.col("v") / 990).alias("air_temperature_c"),
            (F.col("h") / 101).alias("relative_humidity_pct"),
            (F.col("r") / 510).alias("precipitation_mm"),
            (F.col("v") / 1900).alias("soil_temperature_1_c"),
            (F.col("v") / 3700).alias("soil_temperature_2_c"),
            (F.col("h") / 21000).alias("soil_water_1"),
            (F.col("h") / 41000).alias("soil_water_2"),
        )
        return hourly_grid(grid)

    @cached_property
    def overlay(self) -> DataFrame:
        balance = cents(F.col("c_acctbal"))
        cell = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("int")
        area = self.table("customer").groupBy(
            F.col("c_nationkey").cast("string").alias("site"), cell.alias("cell_no")
        ).agg(
            F.sum(F.greatest(balance, F.lit(0))).alias("intersection_area"),
            F.sum(F.abs(balance)).alias("gross_area"),
        )
        of_site = Window.partitionBy("site")  # a handful of cells each
        return (
            area.withColumn("covered_area", F.sum("intersection_area").over(of_site))
            .withColumn("site_area", F.sum("gross_area").over(of_site))
            .where("intersection_area > 0")
            .select(
                "site",
                grid_key(F.lit(45) + F.col("cell_no") / 10, F.lit(13) + F.col("cell_no") / 8).alias("grid_key"),
                "intersection_area",
                "site_area",
                "covered_area",
                (F.col("intersection_area").cast("double") / F.col("covered_area")).alias("cell_weight"),
                (F.col("covered_area").cast("double") / F.col("site_area")).alias("coverage"),
            )
        )

    @cached_property
    def ensemble(self) -> DataFrame:
        """Every line item is a forecast member, issued in its order month with a lead of 1 to 6."""
        line, orders = self.table("lineitem"), self.table("orders")
        joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
        init, lead = F.to_date(F.trunc("o_orderdate", "month")), F.pmod("l_orderkey", F.lit(6)).cast("int") + 1
        return joined.select(
            F.col("l_returnflag").alias("family"),
            init.alias("init_month"),
            F.add_months(init, lead).alias("target_month"),
            lead.alias("lead_month"),
            F.col("l_linenumber").alias("member"),
            F.col("l_suppkey").alias("cell"),
            cents(F.col("l_extendedprice")).alias("value"),
        )

    @cached_property
    def scenario_year(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.table("orders").groupBy(
            F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("year")
        ).agg(
            (F.sum(cents(F.col("o_totalprice"))).cast("double") / n / 990000).alias("temp"),
            (F.sum(F.dayofmonth("o_orderdate")).cast("double") / n / 0.99).alias("humidity"),
            (F.sum(F.month("o_orderdate")).cast("double") / n / 0.99).alias("rain"),
            (F.sum(F.dayofyear("o_orderdate")).cast("double") / n / 0.99).alias("soil"),
            (F.count_if(F.col("o_orderstatus") == "F") * 1000.0 / n / 0.99).alias("rate_a"),
            (F.count_if(F.col("o_orderstatus") == "P") * 1000.0 / n / 0.99).alias("rate_b"),
        )

    @cached_property
    def month_cases(self) -> DataFrame:
        """National months with case rates and weather, from order dates."""
        n = F.count(F.lit(1))
        month = F.to_date(F.trunc("o_orderdate", "month"))
        return self.table("orders").groupBy(month.alias("month_start")).agg(
            n.alias("cases"),
            (F.count_if(F.col("o_orderstatus") == "F") * 1000.0 / n / 0.99).alias("rate_a"),
            (F.sum(cents(F.col("o_totalprice"))).cast("double") / n / 990000).alias("temp"),
            (F.sum(F.dayofmonth("o_orderdate")).cast("double") / n / 0.99).alias("rain"),
        ).select("*", F.year("month_start").alias("year"), F.month("month_start").alias("month"))

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled documents as scored rows; the languages stand for the splits."""
        labels, documents = self.table("labels"), self.table("documents").drop("text")
        split = F.when(F.col("lang") == "en", "test").when(F.col("lang") == "es", "validation").otherwise("train")
        week = F.date_add(F.lit("2024-01-01").cast("date"), F.substring("source", 4, 10).cast("int") * 7)
        return labels.join(documents, "doc_id").select(
            "doc_id",
            split.alias("split"),
            F.col("source").alias("site"),
            week.alias("week_start"),
            F.col("quality").alias("target"),
            F.col("toxic").alias("target_b"),
            F.col("n_chars").cast("double").alias("feature"),
            (F.col("n_chars").cast("double") / (F.col("n_chars") + 1000)).alias("score"),
        )

    @cached_property
    def rated(self) -> DataFrame:
        """All documents as scored rows without a target."""
        split = F.when(F.col("lang") == "en", "test").when(F.col("lang") == "es", "validation").otherwise("train")
        return self.table("documents").drop("text").select(
            "doc_id",
            split.alias("split"),
            F.col("source").alias("site"),
            F.col("n_chars").cast("double").alias("feature"),
            (F.col("n_chars").cast("double") / (F.col("n_chars") + 1000)).alias("score"),
        )

    @cached_property
    def risk_panel(self) -> DataFrame:
        """Site-weeks with a score, split by calendar year."""
        year = F.year("week_start")
        split = F.when(year <= 1999, "train").when(year <= 2000, "validation").otherwise("test")
        return self.site_week.join(self.static_site.select("site", "site_name"), "site").select(
            "site",
            "site_name",
            "week_start",
            split.alias("split"),
            (F.col("cases_a") * 3 >= F.col("line_count")).cast("int").alias("target"),
            (F.col("rain_sum") / (F.col("rain_sum") + F.col("line_count") * 5)).alias("score"),
        )

    @cached_property
    def names(self) -> DataFrame:
        """Part names with accents and punctuation, under zero-padded codes.

        Every third name writes its accents as combining marks, every third has letters beyond Latin Extended-B.
        """
        plain, form = F.initcap("p_name"), F.pmod("p_partkey", F.lit(3))
        marked = F.regexp_replace(F.regexp_replace(plain, "([csz])", "$1\u030c"), "e", "e\u0301")
        accented = (
            F.when(form == 0, marked).when(form == 1, F.translate(plain, "aeou", "ạếộử")).otherwise(F.translate(plain, "ecsz", "éčšž"))
        )
        return self.table("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"),
            F.concat(F.replace(accented, F.lit(" "), F.lit("-")), F.lit(" ("), F.col("p_type"), F.lit(").  ")).alias(
                "raw_name"
            ),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("size"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        e = F.col("embedding")
        x, y = F.get(e, F.lit(0)).cast("double"), F.get(e, F.lit(1)).cast("double")
        codes = F.array(*[F.lit(c) for c in PIXEL_CODES])
        return self.table("embeddings").select(
            F.col("vec_id").alias("pixel_id"),
            x.alias("x"),
            y.alias("y"),
            (F.round(F.get(e, F.lit(2)).cast("double") * 1000) + 0.0).alias("value"),
            F.get(codes, F.pmod(F.col("label"), F.lit(len(PIXEL_CODES)))).alias("code"),
            F.concat_ws("_", F.floor(x / PIXEL_TILE).cast("string"), F.floor(y / PIXEL_TILE).cast("string")).alias("tile"),
            F.floor(y * 1000).cast("int").alias("row_no"),
            F.floor(x * 1000).cast("int").alias("col_no"),
        )

    @cached_property
    def polygons(self) -> DataFrame:
        rows = [
            (site, part, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for site, part, rings in SITE_RINGS
        ]
        return self.spark.createDataFrame(
            rows, "site string, part int, rings array<array<struct<x:double,y:double>>>"
        )


# name -> (relations it needs, SQL)
RELATION_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "order_sites": (
        (),
        """SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS site, CAST(o_orderdate AS DATE) AS order_day,
          o_totalprice, o_orderpriority, o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "site_week": (
        ("order_sites",),
        """SELECT site, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week_start,
          count(*) AS line_count,
          count(*) FILTER (WHERE l_returnflag = 'R') AS cases_a,
          count(*) FILTER (WHERE l_returnflag = 'A') AS cases_b,
          avg(l_quantity) / 0.99::DOUBLE AS temp_mean, min(l_quantity) AS temp_min, max(l_quantity) AS temp_max,
          CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 0.099::DOUBLE AS humid_mean,
          CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 990000 AS rain_sum
        FROM lineitem JOIN order_sites ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    ),
    "yearly_site": (
        ("order_sites",),
        """SELECT site, CAST(year(order_day) + year(order_day) % 2 AS INTEGER) AS year,
          count(*) * 1000 AS population,
          CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 99000 AS density
        FROM order_sites GROUP BY 1, 2""",
    ),
    "static_site": (
        (),
        """SELECT CAST(n_nationkey AS VARCHAR) AS site, n_name AS site_name, r_name AS region_name,
          stations, elevation_mean, elevation_range
        FROM nation JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT s_nationkey, count(*) AS stations,
            CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 990 AS elevation_mean,
            CAST(max(CAST(round(s_acctbal * 100) AS BIGINT)) - min(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE)
              / 1000 AS elevation_range
          FROM supplier GROUP BY 1) AS relief ON n_nationkey = s_nationkey""",
    ),
    "hourly": (
        (),
        """SELECT time, 45 + cell_no::DOUBLE / 10 AS latitude, 13 + cell_no::DOUBLE / 8 AS longitude,
          v / 990 AS air_temperature_c, h / 101 AS relative_humidity_pct, r / 510 AS precipitation_mm,
          v / 1900 AS soil_temperature_1_c, v / 3700 AS soil_temperature_2_c,
          h / 21000 AS soil_water_1, h / 41000 AS soil_water_2,
          printf('%.4f|%.4f', 45 + cell_no::DOUBLE / 10, 13 + cell_no::DOUBLE / 8) AS grid_key
        FROM (SELECT date_trunc('hour', ts) AS time,
            CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS cell_no,
            avg(CAST(round(value * 100) AS BIGINT)) AS v,
            avg(CAST(round(value * 100) AS BIGINT) * 7 % 10000) AS h,
            avg(CAST(round(value * 100) AS BIGINT) % 300) AS r
          FROM events GROUP BY 1, 2) AS means""",
    ),
    "overlay": (
        (),
        """SELECT site, printf('%.4f|%.4f', 45 + cell_no::DOUBLE / 10, 13 + cell_no::DOUBLE / 8) AS grid_key,
          intersection_area, site_area, covered_area,
          intersection_area::DOUBLE / covered_area AS cell_weight, covered_area::DOUBLE / site_area AS coverage
        FROM (SELECT site, cell_no, intersection_area,
            CAST(sum(intersection_area) OVER (PARTITION BY site) AS BIGINT) AS covered_area,
            CAST(sum(gross_area) OVER (PARTITION BY site) AS BIGINT) AS site_area
          FROM (SELECT CAST(c_nationkey AS VARCHAR) AS site,
              CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)
                AS INTEGER) AS cell_no,
              CAST(sum(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0)) AS BIGINT) AS intersection_area,
              CAST(sum(abs(CAST(round(c_acctbal * 100) AS BIGINT))) AS BIGINT) AS gross_area
            FROM customer GROUP BY 1, 2) AS area) AS sites
        WHERE intersection_area > 0""",
    ),
    "ensemble": (
        (),
        """SELECT l_returnflag AS family, CAST(date_trunc('month', o_orderdate) AS DATE) AS init_month,
            CAST(date_trunc('month', o_orderdate) + to_months(CAST(l_orderkey % 6 + 1 AS INTEGER)) AS DATE) AS target_month,
            CAST(l_orderkey % 6 + 1 AS INTEGER) AS lead_month,
            l_linenumber AS member, l_suppkey AS cell, CAST(round(l_extendedprice * 100) AS BIGINT) AS value
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "scenario_year": (
        (),
        """SELECT o_orderpriority AS scenario, CAST(year(o_orderdate) AS INTEGER) AS year,
          CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 990000 AS temp,
          CAST(sum(day(o_orderdate)) AS DOUBLE) / count(*) / 0.99::DOUBLE AS humidity,
          CAST(sum(month(o_orderdate)) AS DOUBLE) / count(*) / 0.99::DOUBLE AS rain,
          CAST(sum(dayofyear(o_orderdate)) AS DOUBLE) / count(*) / 0.99::DOUBLE AS soil,
          count(*) FILTER (WHERE o_orderstatus = 'F') * 1000.0::DOUBLE / count(*) / 0.99::DOUBLE AS rate_a,
          count(*) FILTER (WHERE o_orderstatus = 'P') * 1000.0::DOUBLE / count(*) / 0.99::DOUBLE AS rate_b
        FROM orders GROUP BY 1, 2""",
    ),
    "month_cases": (
        (),
        """SELECT *, CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month
        FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS cases,
            count(*) FILTER (WHERE o_orderstatus = 'F') * 1000.0::DOUBLE / count(*) / 0.99::DOUBLE AS rate_a,
            CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 990000 AS temp,
            CAST(sum(day(o_orderdate)) AS DOUBLE) / count(*) / 0.99::DOUBLE AS rain
          FROM orders GROUP BY 1) AS months""",
    ),
    "scored": (
        (),
        """SELECT doc_id,
          CASE WHEN lang = 'en' THEN 'test' WHEN lang = 'es' THEN 'validation' ELSE 'train' END AS split,
          source AS site, DATE '2024-01-01' + CAST(substr(source, 4) AS INTEGER) * 7 AS week_start,
          quality AS target, toxic AS target_b, n_chars::DOUBLE AS feature,
          n_chars::DOUBLE / (n_chars + 1000) AS score
        FROM labels JOIN documents USING (doc_id)""",
    ),
    "rated": (
        (),
        """SELECT doc_id, CASE WHEN lang = 'en' THEN 'test' WHEN lang = 'es' THEN 'validation' ELSE 'train' END AS split,
          source AS site, n_chars::DOUBLE AS feature, n_chars::DOUBLE / (n_chars + 1000) AS score
        FROM documents""",
    ),
    "risk_panel": (
        ("site_week", "static_site"),
        """SELECT site, site_name, week_start,
          CASE WHEN year(week_start) <= 1999 THEN 'train' WHEN year(week_start) <= 2000 THEN 'validation'
            ELSE 'test' END AS split,
          CAST(cases_a * 3 >= line_count AS INTEGER) AS target, rain_sum / (rain_sum + line_count * 5) AS score
        FROM site_week JOIN static_site USING (site)""",
    ),
    "names": (
        (),
        """SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code,
          replace(CASE p_partkey % 3
              WHEN 0 THEN replace(regexp_replace(plain, '([csz])', '\\1' || chr(780), 'g'), 'e', 'e' || chr(769))
              WHEN 1 THEN translate(plain, 'aeou', 'ạếộử') ELSE translate(plain, 'ecsz', 'éčšž') END, ' ', '-')
            || ' (' || p_type || ').  ' AS raw_name,
          p_brand AS brand, p_retailprice AS price, p_size AS size
        FROM (SELECT *, list_aggregate(list_transform(string_split(p_name, ' '),
              lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS plain FROM part) AS p""",
    ),
    "pixels": (
        (),
        """SELECT vec_id AS pixel_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
          round(embedding[3]::DOUBLE * 1000) + 0.0 AS value,
          CAST([311, 312, 231, 324, 112, 411, 512, 0][label % 8 + 1] AS INTEGER) AS code,
          CAST(floor(embedding[1]::DOUBLE / 0.1::DOUBLE) AS BIGINT)::VARCHAR || '_' ||
            CAST(floor(embedding[2]::DOUBLE / 0.1::DOUBLE) AS BIGINT)::VARCHAR AS tile,
          CAST(floor(embedding[2]::DOUBLE * 1000) AS INTEGER) AS row_no,
          CAST(floor(embedding[1]::DOUBLE * 1000) AS INTEGER) AS col_no
        FROM embeddings""",
    ),
    "edges": (
        (),
        f"""SELECT site, part, ring_no, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2
        FROM (VALUES {_ring_rows()}) AS v(site, part, ring_no, x1, y1, x2, y2)""",
    ),
    "located": (
        ("pixels", "edges"),
        """SELECT pixels.*, (SELECT min(site) FROM (
              SELECT site, part, count(*) FILTER (WHERE (y1 > y) <> (y2 > y)
                AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) AS crossings
              FROM edges GROUP BY site, part) AS c WHERE crossings % 2 = 1) AS site
        FROM pixels""",
    ),
}
