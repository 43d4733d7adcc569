"""Data-quality queries on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import calendar as cal
from biotope.functions import text
from biotope.operators import quality
from biotope.workload.registry import bind
from biotope.workload.scalars import FOLD_SQL, PANEL_YEAR_SQL, panel_with_sources


@bind(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(t):
    return quality.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@bind(
    "name_mismatch",
    """WITH m AS (SELECT DISTINCT c_custkey AS code FROM customer JOIN supplier ON c_custkey = s_suppkey
      WHERE replace(c_name, 'Customer', 'Supplier') <> CASE WHEN s_acctbal < 5000 THEN s_name ELSE s_name || '*' END)
    SELECT (SELECT count(*) FROM m) AS mismatches,
      (SELECT array_to_string(list(code ORDER BY code), ',') FROM (SELECT code FROM m ORDER BY code LIMIT 10) AS f) AS sample""",
)
def name_mismatch(t):
    left = t.table("customer").select(
        F.col("c_custkey").alias("code"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name")
    )
    right = t.table("supplier").select(
        F.col("s_suppkey").alias("code"),
        F.when(F.col("s_acctbal") < 5000, F.col("s_name")).otherwise(F.concat("s_name", F.lit("*"))).alias("name"),
    )
    return quality.name_mismatch(left, right, "code", "name")


def stored_weeks(t):
    """Weeks as a table would store them; busy weeks carry a wrong end."""
    start = F.col("week_start")
    return t.site_week.select(
        "site",
        start,
        F.when(F.col("cases_a") > 2, F.date_add(start, 5)).otherwise(F.date_add(start, 6)).alias("week_end"),
        cal.iso_year(start).alias("iso_year"),
        F.weekofyear(start).alias("iso_week"),
        "cases_a",
        "cases_b",
        (F.col("cases_a") + F.col("cases_b") + (F.col("cases_b") > 2).cast("int")).alias("cases_total"),
    )


@bind(
    "week_bounds_check",
    """SELECT site, week_start, week_start + 5 AS week_end, week_start + 6 AS derived_end FROM site_week WHERE cases_a > 2""",
    needs="site_week",
)
def week_bounds_check(t):
    wrong = quality.wrong_week_bounds(stored_weeks(t), "week_start", "week_end", "iso_year", "iso_week")
    return wrong.select("site", "week_start", "week_end", "derived_end")


@bind(
    "total_identity_check",
    "SELECT site, week_start, cases_a, cases_b, cases_a + cases_b + 1 AS cases_total FROM site_week WHERE cases_b > 2",
    needs="site_week",
)
def total_identity_check(t):
    broken = quality.broken_totals(stored_weeks(t), ["cases_a", "cases_b"], "cases_total")
    return broken.select("site", "week_start", "cases_a", "cases_b", "cases_total")


@bind(
    "table_diff_report",
    """WITH a AS (SELECT site, week_start, cases_a, cases_b FROM site_week WHERE line_count > 1),
      b AS (SELECT site, week_start, CASE WHEN cases_a > 5 THEN cases_a + 1 ELSE cases_a END AS cases_a,
        CASE WHEN cases_b > 5 THEN NULL ELSE cases_b END AS cases_b FROM site_week WHERE cases_a + cases_b > 0),
      j AS (SELECT coalesce(a.site, b.site) AS site, coalesce(a.week_start, b.week_start) AS week_start,
        a.site IS NOT NULL AS in_a, b.site IS NOT NULL AS in_b, a.cases_a AS aa, b.cases_a AS ba, a.cases_b AS ab, b.cases_b AS bb
        FROM a FULL OUTER JOIN b ON a.site = b.site AND a.week_start = b.week_start)
    SELECT site, week_start, CASE WHEN NOT in_b THEN 'missing' ELSE 'unexpected' END AS mismatch, '' AS column_name,
      NULL::VARCHAR AS rebuilt_value, NULL::VARCHAR AS stored_value FROM j WHERE NOT (in_a AND in_b)
    UNION ALL SELECT site, week_start, 'value', 'cases_a', aa::VARCHAR, ba::VARCHAR FROM j WHERE in_a AND in_b AND aa IS DISTINCT FROM ba
    UNION ALL SELECT site, week_start, 'value', 'cases_b', ab::VARCHAR, bb::VARCHAR FROM j WHERE in_a AND in_b AND ab IS DISTINCT FROM bb""",
    needs="site_week",
)
def table_diff_report(t):
    rebuilt = t.once("site_week").where("line_count > 1")
    stored = t.once("site_week").where("cases_a + cases_b > 0").select(
        "site",
        "week_start",
        F.when(F.col("cases_a") > 5, F.col("cases_a") + 1).otherwise(F.col("cases_a")).alias("cases_a"),
        F.when(~(F.col("cases_b") > 5), F.col("cases_b")).alias("cases_b"),
    )
    return quality.table_diff(rebuilt, stored, ["site", "week_start"], ["cases_a", "cases_b"])


@bind(
    "missing_after_join",
    f"""SELECT site, count(*) AS rows_missing FROM ({PANEL_YEAR_SQL}) AS p
    WHERE population IS NULL OR local_humidity IS NULL OR elevation_mean IS NULL GROUP BY 1""",
    needs="site_week yearly_site static_site",
)
def missing_after_join(t):
    return quality.missing_after_join(
        panel_with_sources(t), "site", ["population", "local_humidity", "elevation_mean"]
    )


@bind(
    "conflicting_mapping",
    f"""SELECT folded_name, count(DISTINCT code) AS mapped_count, min(code) AS first_mapped, max(code) AS last_mapped
    FROM (SELECT code, {FOLD_SQL.format('raw_name')} AS folded_name FROM names) AS f GROUP BY 1 HAVING count(DISTINCT code) > 1""",
    needs="names",
)
def conflicting_mapping(t):
    folded = t.names.select("code", text.fold_name(F.col("raw_name")).alias("folded_name"))
    return quality.conflicting_mapping(folded, "folded_name", "code")


@bind(
    "expected_cardinality",
    """SELECT o_orderpriority AS source, CAST(year(order_day) AS INTEGER) AS year, count(DISTINCT site) AS members,
      (SELECT count(*) FROM static_site) AS expected, count(DISTINCT site) = (SELECT count(*) FROM static_site) AS as_expected
    FROM order_sites GROUP BY 1, 2""",
    needs="order_sites static_site",
)
def expected_cardinality(t):
    rows = t.order_sites.select(F.col("o_orderpriority").alias("source"), F.year("order_day").alias("year"), "site")
    expected = t.static_site.agg(F.count(F.lit(1))).scalar()
    return quality.expected_cardinality(rows, ["source", "year"], "site", expected)


@bind(
    "period_sequence_check",
    """SELECT site, count(DISTINCT week_start) AS periods, max(week_start) AS last_period,
      count(DISTINCT week_start) >= 6 AND max(week_start) = (SELECT max(week_start) FROM site_week) AS usable
    FROM site_week GROUP BY 1""",
    needs="site_week",
)
def period_sequence_check(t):
    last = t.once("site_week").agg(F.max("week_start")).scalar()
    return quality.period_sequence(t.once("site_week"), "site", "week_start", last)
