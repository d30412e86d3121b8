"""The library's input shapes, derived from the star-schema tables row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.sources.readers import table

# Certificate columns by the table they need; only tables that are asked for are joined.
CERTIFICATE_COLUMNS: dict[str, tuple[str, str]] = {
    "lodgement_date": ("lineitem", "CAST(l_shipdate AS DATE)"),
    "energy_band": ("lineitem", "l_returnflag"),
    "rating": ("lineitem", "l_quantity"),
    "primary_energy": ("lineitem", "l_extendedprice"),
    "emissions": ("lineitem", "l_quantity * l_discount"),
    "floor_area": ("lineitem", "l_extendedprice * l_tax"),
    "energy_current": ("lineitem", "l_extendedprice"),
    "co2_current": ("lineitem", "l_quantity"),
    "cost_current": ("lineitem", "l_extendedprice * l_tax"),
    "energy_potential": ("lineitem", "l_extendedprice * (1 - l_discount)"),
    "co2_potential": ("lineitem", "l_quantity * (1 - l_discount)"),
    "cost_potential": ("lineitem", "l_extendedprice * l_tax * (1 - l_discount)"),
    "transaction_type": ("lineitem", "l_linestatus"),
    "current_rating": ("lineitem", "l_returnflag"),
    "potential_rating": ("lineitem", "l_linestatus"),
    "low_energy_lighting": ("lineitem", "CAST(l_linenumber AS STRING)"),
    "floor_level": ("lineitem", "CAST(l_linenumber AS STRING)"),
    "energy_tariff": ("lineitem", "l_returnflag"),
    "mains_gas_flag": ("lineitem", "CASE WHEN l_discount > 0.05 THEN 'Y' ELSE 'N' END"),
    "property_type": ("part", "p_type"),
    "heating_category": ("part", "p_brand"),
    "main_fuel": ("part", "p_brand"),
    "new_build_rating": ("part", "CAST(p_size AS DOUBLE)"),
    "construction_age_band": ("orders", "o_orderpriority"),
    "tenure": ("orders", "o_orderpriority"),
    "report_type": ("orders", "o_orderstatus"),
    "new_build_band": ("orders", "o_orderstatus"),
    "constituency": ("customer", "c_mktsegment"),
    "local_authority": ("nation", "n_name"),
    "post_town": ("nation", "n_name"),
    "county": ("region", "r_name"),
}
_CHAIN = {
    "part": ("lineitem", "l_partkey", "p_partkey"), "orders": ("lineitem", "l_orderkey", "o_orderkey"),
    "customer": ("orders", "o_custkey", "c_custkey"), "nation": ("customer", "c_nationkey", "n_nationkey"),
    "region": ("nation", "n_regionkey", "r_regionkey"),
}


def _needed_tables(columns: list[str]) -> list[str]:
    needed: list[str] = []

    def add(name: str) -> None:
        if name == "lineitem" or name in needed:
            return
        add(_CHAIN[name][0])
        needed.append(name)

    for c in columns:
        add(CERTIFICATE_COLUMNS[c][0])
    return needed


def certificates(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    for name in _needed_tables(list(columns)):
        _, left, right = _CHAIN[name]
        df = df.join(table(spark, folder, name), F.col(left) == F.col(right), "left")
    return df.select(*[F.expr(CERTIFICATE_COLUMNS[c][1]).alias(c) for c in columns])


def certificates_sql(*columns: str) -> str:
    """The same rows as a subquery in ANSI SQL."""
    joins = "".join(f" LEFT JOIN {n} ON {_CHAIN[n][1]} = {_CHAIN[n][2]}" for n in _needed_tables(list(columns)))
    picked = ", ".join(f"{CERTIFICATE_COLUMNS[c][1]} AS {c}" for c in columns)
    return f"(SELECT {picked} FROM lineitem{joins})"


def _as_sql(columns: dict[str, str], source: str) -> str:
    """Derived columns as a subquery for the SQL check, which spells array constructors its own way."""
    picked = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"(SELECT {picked.replace('array(', 'list_value(')} FROM {source})"


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


METERS = {
    "meterNo": "user_id", "fuelType": "event_type",
    "consumption": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END",
    "readingType": "CASE WHEN event_id % 2 = 0 THEN 'Estimated' ELSE 'Actual' END",
    "month": "CAST(month(ts) AS INT)", "year": "CAST(year(ts) AS INT)",
}
METERS_SQL = _as_sql(METERS, "events")


def meters(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(table(spark, folder, "events"), METERS)


ORDER_MONTHS = {"meterNo": "o_custkey", "month": "CAST(month(o_orderdate) AS INT)", "year": "CAST(year(o_orderdate) AS INT)"}
ORDER_MONTHS_SQL = _as_sql(ORDER_MONTHS, "orders")


def order_months(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(table(spark, folder, "orders"), ORDER_MONTHS)


# Query metrics: duration runs from 0 to about 10 s, every third row is unrated.
QUERY_LOG = {
    "event_id": "event_id", "ts": "CAST(ts AS TIMESTAMP)", "user_id": "user_id", "event_type": "event_type", "intent": "event_type",
    "duration": "value / 50", "success": "event_type <> 'error'", "pattern_updated": "event_type = 'purchase'",
    "user_satisfaction": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS INT) END",
    "collection_name": "CASE WHEN user_id % 2 = 0 THEN 'connections' ELSE 'tech' END",
    "log_level": "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'info' END",
    "component": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('part-', CAST(user_id % 7 AS STRING)) END",
    "operation": "event_type", "value": "value", "props": "props",
}
QUERY_LOG_SQL = _as_sql(QUERY_LOG, "events")


def query_log_of(events: DataFrame) -> DataFrame:
    return _derive(events, QUERY_LOG)


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    return query_log_of(table(spark, folder, "events"))


# Connections: one document per customer, arrays built inside the row.
_AREA = "substr(n_name, 1, 1) || chr(CAST(65 + n_nationkey AS INT)) || CAST(c_custkey % 20 + 1 AS STRING)"
_REFERENCE = "CAST(10000000000 + c_custkey AS STRING)"
CONNECTIONS = {
    "_id": "c_custkey",
    "UPRN": f"array({_REFERENCE})",
    "EMSN": "array('24E' || lpad(CAST(c_custkey AS STRING), 7, '0'))",
    "MPAN": "array('12' || lpad(CAST(c_custkey * 7 AS STRING), 11, '0'))",
    "MPRN": "array('91' || lpad(CAST(c_custkey * 3 AS STRING), 8, '0'), '92' || lpad(CAST(c_custkey * 3 AS STRING), 8, '0'))",
    "POSTCODE": f"array({_AREA} || ' ' || CAST(c_custkey % 9 + 1 AS STRING) || 'UN')",
    "ADDRESS": "array('FLAT ' || CAST(c_custkey % 40 + 1 AS STRING) || ', ' || upper(n_name) || 'GATE DRIVE, ' || c_mktsegment)",
    "api_ok": "CAST(c_acctbal >= 0 AS STRING)",
}
CUSTOMER_NATION = "customer JOIN nation ON c_nationkey = n_nationkey"
CONNECTIONS_SQL = _as_sql(CONNECTIONS, CUSTOMER_NATION)


def customer_nation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def connections(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(customer_nation(spark, folder), CONNECTIONS)


# Questions: one per customer, eight ways of asking in turn.
QUESTIONS = {
    "question_id": "c_custkey",
    "question": f"""CASE c_custkey % 8
      WHEN 0 THEN 'find connections by EMSN 24E' || lpad(CAST(c_custkey AS STRING), 7, '0')
      WHEN 1 THEN 'search connections in ' || {_AREA} || ' area'
      WHEN 2 THEN 'check xoserveMeters API status'
      WHEN 3 THEN 'find connections on ' || upper(n_name) || 'GATE DRIVE'
      WHEN 4 THEN 'show connection details for UPRN number ' || {_REFERENCE}
      WHEN 5 THEN 'what is known about ' || {_REFERENCE}
      WHEN 6 THEN 'What are the most common errors in MPAN records by supplier and postcode?'
      ELSE 'find ' || {_AREA} || ' on ' || substr(upper(n_name), 1, 4) || ' DRIVE' END""",
}
QUESTIONS_SQL = _as_sql(QUESTIONS, CUSTOMER_NATION)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(customer_nation(spark, folder), QUESTIONS)


# Dirty numeric text: one kind of mess per line number.
_AMOUNT = "CAST(CAST(l_quantity AS INT) AS STRING)"
DIRTY = {
    "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber",
    "reading": f"""CASE l_linenumber
      WHEN 1 THEN {_AMOUNT} || ' kWh'
      WHEN 2 THEN {_AMOUNT} || '%'
      WHEN 3 THEN {_AMOUNT} || '-' || CAST(CAST(l_quantity AS INT) + 10 AS STRING) || ' kWh'
      WHEN 4 THEN 'N/A'
      WHEN 5 THEN {_AMOUNT} || ' to ' || CAST(CAST(l_quantity AS INT) + 5 AS STRING)
      WHEN 6 THEN '-' || {_AMOUNT}
      ELSE 'about ' || {_AMOUNT} || ' units' END""",
    "is_discounted": "CASE WHEN l_discount > 0.05 THEN 'Yes' ELSE 'No' END",
    "ship_text": "CASE WHEN l_linenumber = 4 THEN 'soon' ELSE substr(CAST(l_shipdate AS STRING), 1, 10) END",
    "battery_capacity": f"{_AMOUNT} || '.' || CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber > 4 THEN '...' ELSE '' END",
    "return_type": "l_returnflag",
}
DIRTY_SQL = _as_sql(DIRTY, "lineitem")


def dirty_readings(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(table(spark, folder, "lineitem"), DIRTY)
