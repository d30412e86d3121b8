"""EPC, MTR and VEH reports."""

from __future__ import annotations


from pyspark.sql import functions as F

from emberlake.catalog.base import query, rounded
from emberlake.plans import certificates as C
from emberlake.plans import meters as M
from emberlake.plans import vehicles as V
from emberlake.plans.stand_ins import METERS_SQL, ORDER_MONTHS_SQL, certificates, certificates_sql, meters, order_months
from emberlake.sources.readers import table

CATEGORIES = (
    "property_type", "transaction_type", "local_authority", "constituency", "county", "energy_tariff", "main_fuel",
    "floor_level", "tenure", "report_type", "mains_gas_flag",
)
_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM c" for c in CATEGORIES)


@query("epc01_category_counts", f"""
WITH c AS {certificates_sql(*CATEGORIES)}, u AS ({_UNPIVOT})
SELECT "column", value, count(*) AS count FROM u WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return C.category_counts(certificates(spark, sf, *CATEGORIES), CATEGORIES)


@query("epc01_category_sizes", f"""
WITH c AS {certificates_sql(*CATEGORIES)}, u AS ({_UNPIVOT})
SELECT "column", count(DISTINCT value) AS distinct_values FROM u GROUP BY 1""")
def _(spark, sf):
    return C.category_sizes(certificates(spark, sf, *CATEGORIES), CATEGORIES)


def _count_report(name: str, column: str) -> None:
    @query(name, f"SELECT {column}, count(*) AS count FROM {certificates_sql(column)} c WHERE {column} IS NOT NULL GROUP BY 1")
    def _(spark, sf):
        return C.count_by(certificates(spark, sf, column), column)


def _mean_report(name: str, key: str, measure: str) -> None:
    @query(name, f"SELECT {key}, round(avg({measure}), 4) AS avg_{measure} FROM {certificates_sql(key, measure)} c WHERE {key} IS NOT NULL GROUP BY 1")
    def _(spark, sf):
        return rounded(C.mean_by(certificates(spark, sf, key, measure), key, measure))


_count_report("epc02_energy_bands", "energy_band")
_mean_report("epc06_floor_area_by_property_type", "property_type", "floor_area")
_mean_report("epc08_new_build_rating_by_band", "new_build_band", "new_build_rating")
_count_report("epc12_property_types", "property_type")
_count_report("epc13_heating_categories", "heating_category")
_count_report("epc14_transaction_types", "transaction_type")
_count_report("epc15_local_authorities", "local_authority")
_count_report("epc17_construction_age_bands", "construction_age_band")
_mean_report("epc20_total_floor_area_by_property_type", "property_type", "primary_energy")


def _monthly_report(name: str, measures: dict[str, str], counted: str | None = None, axis: str = "date") -> None:
    columns = ["lodgement_date", *measures, *([counted] if counted else [])]
    stats = ", ".join(f"round(avg({m}), 4) AS avg_{n}, round(median({m}), 7) AS median_{n}" for m, n in measures.items())
    label = {
        "date": "strftime(make_date(lodgement_year, lodgement_month, 1), '%Y-%m-%d') AS date",
        "year_month": "printf('%04d-%02d', lodgement_year, lodgement_month) AS year_month",
    }[axis]

    @query(name, f"""
WITH c AS (SELECT *, year(lodgement_date) AS lodgement_year, month(lodgement_date) AS lodgement_month FROM {certificates_sql(*columns)} x),
g AS (SELECT lodgement_year, lodgement_month, count({counted or '*'}) AS total_certificates, {stats}
      FROM c WHERE lodgement_year IS NOT NULL GROUP BY 1, 2)
SELECT *, {label} FROM g""")
    def _(spark, sf):
        df = C.monthly_changes(certificates(spark, sf, *columns), "lodgement_date", measures, counted, axis)
        # A median halves a sum of products of cents; seven digits hold it exactly.
        return rounded(df.withColumns({f"median_{n}": F.round(f"median_{n}", 7) for n in measures.values()}), 4, keep="median_")


_monthly_report(
    "epc03_monthly_changes", {"primary_energy": "primary_energy_value", "emissions": "building_emissions", "floor_area": "floor_area"}, "energy_band"
)
_monthly_report("epc09_monthly_energy_and_co2", {"energy_current": "energy_consumption", "co2_current": "co2_emissions"})
_monthly_report("epc10_monthly_changes_by_label", {"energy_current": "energy_consumption", "co2_current": "co2_emissions"}, None, "year_month")
_monthly_report(
    "epc11_monthly_current_and_potential",
    {m: m for m in ("energy_current", "co2_current", "cost_current", "energy_potential", "co2_potential", "cost_potential")}, None, "year_month",
)
_monthly_report(
    "epc22_monthly_non_domestic", {"primary_energy": "primary_energy_value", "emissions": "building_emissions", "floor_area": "floor_area"}, None, "year_month"
)


def _means_report(name: str, measures: dict[str, str]) -> None:
    union = " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({c}), 4) AS value FROM c" for c, n in measures.items())

    @query(name, f"WITH c AS {certificates_sql(*measures)} {union}")
    def _(spark, sf):
        return rounded(C.metric_means(certificates(spark, sf, *measures), measures))


_means_report("epc04_average_emissions", {"emissions": "Building Emissions", "primary_energy": "Primary Energy Value"})
_means_report("epc19_average_co2_and_energy", {"co2_current": "CO2 Emissions", "energy_current": "Energy Consumption"})


@query("epc05_yearly_mean_rating", f"""
SELECT CAST(year(lodgement_date) AS BIGINT) AS lodgement_year, round(avg(rating), 4) AS avg_rating
FROM {certificates_sql("lodgement_date", "rating")} c GROUP BY 1""")
def _(spark, sf):
    return rounded(C.yearly_mean(certificates(spark, sf, "lodgement_date", "rating"), "lodgement_date", "rating"))


@query("epc07_top_post_towns", f"""
SELECT post_town, count(*) AS count FROM {certificates_sql("post_town")} c WHERE post_town IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return C.most_frequent(certificates(spark, sf, "post_town"), "post_town", 10)


@query("epc16_low_energy_lighting_share", f"""
SELECT low_energy_lighting, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent
FROM {certificates_sql("low_energy_lighting")} c WHERE low_energy_lighting IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rounded(C.shares(certificates(spark, sf, "low_energy_lighting"), "low_energy_lighting"))


@query("epc18_rating_distribution", f"""
WITH c AS {certificates_sql("current_rating", "potential_rating")}
SELECT 'current' AS kind, current_rating AS rating, count(*) AS count FROM c GROUP BY 2
UNION ALL SELECT 'potential', potential_rating, count(*) FROM c GROUP BY 2""")
def _(spark, sf):
    return C.paired_distribution(certificates(spark, sf, "current_rating", "potential_rating"), "current_rating", "potential_rating")


@query("epc21_ratings_by_year", f"""
SELECT CAST(year(lodgement_date) AS BIGINT) AS lodgement_year, current_rating, count(*) AS count
FROM {certificates_sql("lodgement_date", "current_rating")} c GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(C.yearly_ratings(certificates(spark, sf, "lodgement_date", "current_rating"), "lodgement_date", "current_rating"))


@query("epc23_group_summary", f"""
SELECT energy_band, round(avg(rating), 4) AS mean_rating, round(avg(primary_energy), 4) AS mean_primary_energy,
  round(avg(emissions), 4) AS mean_emissions, count(rating) AS count_rating, count(primary_energy) AS count_primary_energy,
  count(emissions) AS count_emissions
FROM {certificates_sql("energy_band", "rating", "primary_energy", "emissions")} c GROUP BY 1""")
def _(spark, sf):
    return rounded(C.group_summary(certificates(spark, sf, "energy_band", "rating", "primary_energy", "emissions"), "energy_band"))


# --- meter readings ----------------------------------------------------------------------------------

@query("mtr01_meter_count", f"SELECT count(DISTINCT meterNo) AS meters FROM {METERS_SQL} m")
def _(spark, sf):
    return M.meter_count(meters(spark, sf))


@query("mtr02_meters_by_fuel", f"SELECT fuelType, count(DISTINCT meterNo) AS meters FROM {METERS_SQL} m GROUP BY 1")
def _(spark, sf):
    return M.meters_by_fuel(meters(spark, sf))


def _ratio_sql(key: str) -> str:
    return f"""WITH s AS (SELECT {key}, sum(consumption) FILTER (readingType = 'Estimated') AS e, sum(consumption) FILTER (readingType = 'Actual') AS a
FROM {METERS_SQL} m GROUP BY 1)
SELECT {key}, round(e, 2) AS "Estimated", round(a, 2) AS "Actual", round(e / nullif(a, 0) * 100, 2) AS "Estimated_vs_Actual" FROM s"""


@query("mtr03_consumption_by_meter", _ratio_sql("meterNo"))
def _(spark, sf):
    return rounded(M.consumption_by(meters(spark, sf), "meterNo"), 2)


@query("mtr05_consumption_by_fuel", _ratio_sql("fuelType"))
def _(spark, sf):
    return rounded(M.consumption_by(meters(spark, sf), "fuelType"), 2)


@query("mtr04_overall_ratio", f"""
WITH s AS (SELECT sum(consumption) FILTER (readingType = 'Estimated') AS e, sum(consumption) FILTER (readingType = 'Actual') AS a FROM {METERS_SQL} m)
SELECT round(e, 2) AS total_estimated, round(a, 2) AS total_actual, round(e / nullif(a, 0) * 100, 2) AS overall_percent FROM s""")
def _(spark, sf):
    return rounded(M.overall_ratio(meters(spark, sf)), 2)


_COVERAGE_SQL = f"""SELECT meterNo, count(DISTINCT (year, month)) AS months_available, 80 - count(DISTINCT (year, month)) AS months_missing,
  round(count(DISTINCT (year, month)) * 100.0 / 80, 1) AS coverage FROM {ORDER_MONTHS_SQL} m GROUP BY 1"""


@query("mtr06_month_coverage", _COVERAGE_SQL)
def _(spark, sf):
    return M.coverage(order_months(spark, sf), 80)


@query("mtr07_coverage_summary", f"""
WITH c AS ({_COVERAGE_SQL})
SELECT count(*) AS meters, count(*) FILTER (months_available = 80) AS complete_meters, round(avg(coverage), 1) AS average_coverage FROM c""")
def _(spark, sf):
    return rounded(M.coverage_summary(order_months(spark, sf), 80), 1)


@query("mtr08_meters_with_gaps", f"SELECT DISTINCT meterNo FROM {METERS_SQL} m WHERE consumption IS NULL")
def _(spark, sf):
    return M.meters_with_gaps(meters(spark, sf))


@query("mtr08_gap_summary", f"""
WITH p AS (SELECT meterNo, bool_or(consumption IS NULL) AS gap FROM {METERS_SQL} m GROUP BY 1)
SELECT count(*) FILTER (gap) AS missing_meters, count(*) AS meters, round(count(*) FILTER (gap) * 100.0 / count(*), 1) AS missing_percent FROM p""")
def _(spark, sf):
    return M.gap_summary(meters(spark, sf))


@query("mtr09_missing_records", f"""
SELECT count(*) FILTER (consumption IS NULL) AS missing, round(count(*) FILTER (consumption IS NULL) * 100.0 / count(*), 1) AS missing_percent
FROM {METERS_SQL} m""")
def _(spark, sf):
    return M.missing_records(meters(spark, sf))


# --- vehicles ----------------------------------------------------------------------------------------

@query("veh01_best_row", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part
ORDER BY p_retailprice DESC, p_partkey LIMIT 1""")
def _(spark, sf):
    return rounded(V.best_row(table(spark, sf, "part"), "p_retailprice", "p_partkey"))


@query("veh02_top_rows", """
SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part ORDER BY part.p_size DESC, p_partkey LIMIT 5""")
def _(spark, sf):
    return rounded(V.top_rows(table(spark, sf, "part"), "p_size", "p_partkey").select("p_partkey", "p_name", "p_size"))


@query("veh03_spread", """
SELECT round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, round(stddev_samp(p_retailprice), 4) AS std,
  min(p_retailprice) AS min, max(p_retailprice) AS max FROM part""")
def _(spark, sf):
    return rounded(V.spread(table(spark, sf, "part"), "p_retailprice"))


