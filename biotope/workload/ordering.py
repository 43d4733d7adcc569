"""Sorts, limits, top-k, samples and set operations on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import text
from biotope.operators import metrics, windows
from biotope.plans import risk
from biotope.workload.registry import bind


@bind(
    "numeric_aware_sort",
    """SELECT code, coalesce(TRY_CAST(code AS INTEGER), 1000000000) AS sort_number, rows FROM (
      SELECT CASE WHEN o_orderstatus = 'P' THEN 'P' || site ELSE site END AS code, count(*) AS rows FROM order_sites GROUP BY 1)
      AS c ORDER BY 2, 1""",
    needs="order_sites",
)
def numeric_aware_sort(t):
    code = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("P"), "site")).otherwise(F.col("site"))
    counted = t.order_sites.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    number = F.coalesce(F.col("code").try_cast("int"), F.lit(1_000_000_000))
    return counted.withColumn("sort_number", number).orderBy(*text.code_order(F.col("code")))


@bind(
    "multi_key_sort",
    "SELECT site, site_name, week_start, target, score FROM risk_panel ORDER BY target DESC, score DESC, site_name",
    needs="risk_panel",
)
def multi_key_sort(t):
    rows = t.risk_panel.select("site", "site_name", "week_start", "target", "score")
    return rows.orderBy(*risk.site_order("target", "score", "site_name"))


@bind(
    "top_k_sites",
    """SELECT split, site, week_start, score, position FROM (SELECT *, CAST(row_number() OVER (
        PARTITION BY split ORDER BY target DESC, score DESC, site_name, week_start) AS INTEGER) AS position FROM risk_panel) AS r
    WHERE position <= 8""",
    needs="risk_panel",
)
def top_k_sites(t):
    order = [*risk.site_order("target", "score", "site_name"), F.col("week_start").asc()]
    top = windows.top_per_key(t.risk_panel, ["split"], order, risk.TOP_SITES, "position")
    return top.select("split", "site", "week_start", "score", "position")


@bind(
    "top_k_features",
    """SELECT name, importance, CASE name WHEN 'elevation_m_std' THEN 'razgiban relief'
      WHEN 'forest_cover_pct' THEN 'gozdna pokrovnost' ELSE replace(name, '_', ' ') END AS label
    FROM (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'elevation_m_std' WHEN p_brand = 'Brand#2' THEN 'forest_cover_pct'
        ELSE lower(replace(p_brand, '#', '_')) || '_' || lower(p_type) END AS name,
        CAST(sum(p_size) AS BIGINT) AS importance FROM part GROUP BY 1) AS f
    ORDER BY importance DESC, name LIMIT 12""",
)
def top_k_features(t):
    brand = F.col("p_brand")
    name = (
        F.when(brand == "Brand#1", "elevation_m_std")
        .when(brand == "Brand#2", "forest_cover_pct")
        .otherwise(F.concat_ws("_", F.lower(F.replace(brand, F.lit("#"), F.lit("_"))), F.lower("p_type")))
    )
    features = t.table("part").groupBy(name.alias("name")).agg(F.sum("p_size").alias("importance"))
    top = features.orderBy(F.desc("importance"), F.asc("name")).limit(12)
    return top.withColumn("label", risk.feature_label(F.col("name")))


@bind(
    "top_fraction",
    """SELECT split, count(*) AS top_rows, avg(target) AS top_precision, avg(target) / any_value(prevalence) AS top_lift
    FROM (SELECT split, target, row_number() OVER (PARTITION BY split ORDER BY score DESC, doc_id) AS position,
        count(*) OVER (PARTITION BY split) AS n, avg(target) OVER (PARTITION BY split) AS prevalence FROM scored) AS r
    WHERE position <= greatest(1, floor(n * 0.01::DOUBLE)) GROUP BY 1""",
    needs="scored",
    rounded="top_precision top_lift",
)
def top_fraction(t):
    return metrics.top_fraction(t.scored.select("doc_id", "split", "target", "score"), "target", "score", "doc_id", ["split"])


@bind(
    "panel_order",
    "SELECT site, week_start, cases_a FROM site_week ORDER BY site, week_start",
    needs="site_week",
)
def panel_order(t):
    return t.site_week.select("site", "week_start", "cases_a").orderBy("site", "week_start")


@bind("seeded_sample", "SELECT * FROM rated ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 200", needs="rated")
def seeded_sample(t):
    return windows.seeded_sample(t.rated, "doc_id", 200, 42)


@bind("row_limit", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def row_limit(t):
    return t.table("documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(25)


@bind(
    "union_all_by_name",
    """SELECT 'a' AS model, site, week_start, cases_a AS cases, temp_mean FROM site_week
    UNION ALL SELECT 'b', site, week_start, cases_b, NULL FROM site_week""",
    needs="site_week",
)
def union_all_by_name(t):
    a = t.once("site_week").select(F.lit("a").alias("model"), "site", "week_start", F.col("cases_a").alias("cases"), "temp_mean")
    b = t.once("site_week").select(F.lit("b").alias("model"), F.col("cases_b").alias("cases"), "site", "week_start")
    return a.unionByName(b, allowMissingColumns=True)


KEYS_SQL = """a AS (SELECT site, CAST(date_trunc('week', order_day) AS DATE) AS week_start FROM order_sites),
      b AS (SELECT site, week_start FROM site_week)"""


def key_sets(t):
    from biotope.functions.calendar import week_start

    a = t.order_sites.select("site", week_start(F.col("order_day")).alias("week_start"))
    return a, t.site_week.select("site", "week_start")


@bind("union_distinct_keys", f"WITH {KEYS_SQL} SELECT * FROM a UNION SELECT * FROM b", needs="order_sites site_week")
def union_distinct_keys(t):
    a, b = key_sets(t)
    return a.union(b).distinct()


@bind("except_keys", f"WITH {KEYS_SQL} SELECT * FROM b EXCEPT SELECT * FROM a", needs="order_sites site_week")
def except_keys(t):
    a, b = key_sets(t)
    return b.subtract(a)
