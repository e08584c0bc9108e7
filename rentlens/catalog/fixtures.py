"""Rental tables derived from the given star-schema tables.

Each fixture is one SQL text that runs unchanged in Spark and in the checking engine
(names in backticks become double quotes there). The row counts follow the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rentlens.functions.features import PERIOD_COLUMNS, SIZE_COLUMNS
from rentlens.functions.parsing import STATES

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

TABLE_MARK = re.compile(r"\{(" + "|".join(BASE_TABLES) + r")\}")

NBSP = " "


def _cases(selector: str, count: int, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} % {count} {whens} END"


def _states() -> str:
    rows = ", ".join(f"({i}, '{code}', '{name}')" for i, (code, name) in enumerate(STATES))
    return f"SELECT * FROM (VALUES {rows}) AS t(k, code, name)"


def _bands(columns: list[str], step: str) -> str:
    """Rent per band, null for every fifth (nation, band); steps are exact in binary."""
    middle = len(columns) // 2
    return ", ".join(
        f"CASE WHEN (n_nationkey + {i}) % 5 = 0 THEN NULL "
        f"ELSE (n_nationkey % 12 + 5.5e0) + ({i - middle}) * {step} END AS `{c}`"
        for i, c in enumerate(columns)
    )


LISTING_COLUMNS = f"""
    o.o_orderkey AS listing_id,
    o.o_totalprice / 200.0e0 AS baseRent,
    {{lines}}
    CASE WHEN o.o_orderkey % 9 = 0 THEN NULL
         ELSE CAST(o.o_orderkey % 70 - 4 AS DOUBLE) END AS floor,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
         ELSE CAST(1900 + o.o_orderkey % 125 AS DOUBLE) END AS yearConstructed,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
         ELSE CAST(o.o_custkey % 300 AS STRING) || ','
              || LPAD(CAST(o.o_orderkey % 100 AS STRING), 2, '0') END AS serviceCharge,
    CASE WHEN o.o_orderkey % 4 = 0 THEN NULL
         WHEN o.o_orderkey % 7 = 0 THEN 0.0e0
         ELSE o.o_totalprice / 200.0e0 + o.o_custkey % 300 END AS totalRent,
    CASE WHEN o.o_orderkey % 6 = 0 THEN NULL
         ELSE (o.o_orderkey % 100) / 8.0e0 END AS pricetrend,
    s.name AS regio1,
    'NATION_' || CAST(c.c_nationkey % 20 AS STRING) || ' Hansestadt' AS regio2,
    CASE WHEN o.o_orderkey % 11 = 0 THEN 'Weiler_' || CAST(o.o_orderkey % 50 AS STRING)
         ELSE 'NATION_' || CAST(c.c_nationkey % 20 AS STRING) END
        || CASE o.o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', Stadt'
           WHEN 2 THEN ' (Kreis)' END AS regio3,
    CASE WHEN o.o_orderkey % 7 = 0 THEN CAST(90000 + o.o_orderkey % 900 AS STRING)
         ELSE LPAD(CAST(c.c_custkey % 700 AS STRING), 5, '0') END AS geo_plz,
    CASE WHEN o.o_orderkey % 3 <> 0
         THEN 'Kreis ' || s.code || LPAD(CAST(c.c_nationkey AS STRING), 3, '0') END AS geo_krs,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'ja' WHEN 1 THEN 'nein' WHEN 2 THEN 'TRUE'
         WHEN 3 THEN 'false' END AS hasKitchen,
    CASE o.o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'n' ELSE '1' END AS balcony,
    CASE o.o_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'ja' END AS garden,
    CASE o.o_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS lift,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'central_heating'
         WHEN 'BUILDING' THEN 'district_heating' WHEN 'FURNITURE' THEN 'gas_heating'
         WHEN 'HOUSEHOLD' THEN NULL ELSE LOWER(c.c_mktsegment) END AS heatingType,
    o.o_orderpriority AS typeOfFlat,
    CASE o.o_orderstatus WHEN 'F' THEN 'Saniert' WHEN 'O' THEN 'NEU' END AS `condition`,
    CAST(o.o_orderdate AS DATE) AS listed_on
"""

SQL: dict[str, str] = {
    "fx_states": _states(),
    "fx_lines": """
        SELECT l_orderkey, SUM(l_quantity) AS q, COUNT(*) AS k FROM {lineitem} GROUP BY l_orderkey
    """,
    # One listing per order.
    "fx_listings": "SELECT "
    + LISTING_COLUMNS.replace(
        "{lines}", "l.q AS livingSpace, CAST(l.k AS DOUBLE) AS noRooms,"
    )
    + """
        FROM {orders} o
        JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN fx_states s ON c.c_nationkey % 16 = s.k
        LEFT JOIN fx_lines l ON l.l_orderkey = o.o_orderkey
    """,
    # The same listings without the two columns that need the line items.
    "fx_places_listed": "SELECT "
    + LISTING_COLUMNS.replace("{lines}", "")
    + """
        FROM {orders} o
        JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN fx_states s ON c.c_nationkey % 16 = s.k
    """,
    "fx_keymap": """
        SELECT s.code || LPAD(CAST(c.c_nationkey AS STRING), 3, '0') || '0000000' AS ARS,
               s.code || LPAD(CAST(c.c_nationkey AS STRING), 3, '0') || '000' AS AGS,
               'NATION_' || CAST(c.c_nationkey % 20 AS STRING) || ', Stadt' AS Gemeindename,
               LPAD(CAST(c.c_custkey % 700 AS STRING), 5, '0') AS PLZ,
               c.c_mktsegment AS Ort,
               c.c_custkey AS row_no
        FROM {customer} c JOIN fx_states s ON c.c_nationkey % 16 = s.k
    """,
    "fx_zensus": f"""
        SELECT s.code || LPAD(CAST(n_nationkey AS STRING), 3, '0') || '0000000' AS GKZ,
               'NATION_' || CAST(n_nationkey % 20 AS STRING) || ', Stadt' AS Gemeindename,
               n_nationkey % 12 + 5.5e0 AS Insgesamt,
               {_bands(PERIOD_COLUMNS, '0.25e0')}
        FROM {{nation}} JOIN fx_states s ON n_nationkey % 16 = s.k
    """,
    "fx_zensus_sizes": f"""
        SELECT s.code || LPAD(CAST(n_nationkey AS STRING), 3, '0') || '0000000' AS GKZ,
               'NATION_' || CAST(n_nationkey % 20 AS STRING) || ', Stadt' AS Gemeindename,
               n_nationkey % 12 + 5.5e0 AS Insgesamt,
               {_bands(SIZE_COLUMNS, '0.125e0')}
        FROM {{nation}} JOIN fx_states s ON n_nationkey % 16 = s.k
    """,
    # Spelling variants of place names, one per customer.
    "fx_places": f"""
        SELECT c_custkey AS place_id, {_cases(
            "c_custkey", 24,
            "'Kiel, Landeshauptstadt'",
            "'Burg (Dith.)'",
            "'St.Ingbert'",
            "'Frankfurt a. d. Oder'",
            "'Groß-Gerau'",
            "'Hansestadt Lübeck'",
            f"'Bad{NBSP}Honnef, Stadt'",
            "NULL",
            "''",
            "'  Köln  '",
            "'Musterort (Altstadt), Kreis Nord'",
            "'Weimar, kreisfreie Stadt'",
            "'Amt ' || c_mktsegment || ' Gemeinde'",
            "'Rottach am See'",
            "'Neuburg an der Donau'",
            "'Halle/Saale; Ost'",
            "'Stadt ' || c_mktsegment",
            "c_mktsegment || ' Landeshauptstadt Hansestadt'",
            "'St. ' || c_mktsegment",
            "c_mktsegment || ' Markt, Stadt'",
            "'Verbandsgemeinde ' || CAST(c_nationkey AS STRING)",
            "c_mktsegment || ' kreisfreie Stadt'",
            "'Ort.' || CAST(c_custkey % 50 AS STRING) || ' (Kreis ' "
            "|| CAST(c_nationkey AS STRING) || ')'",
            "'Marburg Universitätsstadt'",
        )} AS raw_name
        FROM {{customer}}
    """,
    # Number, flag, category and key spellings, one row per order.
    "fx_texts": f"""
        SELECT o_orderkey AS text_id, {_cases(
            "o_orderkey", 16,
            "whole || ',' || cents", "whole || '.' || cents",
            "'1.' || LPAD(whole, 3, '0') || ',' || cents || ' €'",
            "whole || ',' || cents || ' €/m²'", "'(' || whole || ',' || cents || ')'",
            "whole || ',' || cents || 'e'", "'/'", "NULL", "''", "'nan'", "' ' || whole || ' '",
            "whole || 'd'", "'1e3'", "'-' || whole || ',' || cents",
            "'ca. ' || whole || ' (etwa)'", "whole || ' € / m²'",
        )} AS num_text, {_cases(
            "o_orderkey", 14,
            "'true'", "'false'", "' Ja '", "'nein'", "'YES'", "'no'", "'y'", "'n'", "'t'", "'f'",
            "'1'", "'0'", "'vielleicht'", "NULL",
        )} AS flag_text, {_cases(
            "o_orderkey", 6,
            "' Alt/Neu ; Bau '", "'GAS  heating'", "NULL", "''", "'oil;gas'", "o_orderpriority",
        )} AS category_text, {_cases(
            "o_orderkey", 6,
            "'1001000' || LPAD(whole, 3, '0')", "'010010000' || LPAD(whole, 3, '0')",
            "'0100100000' || LPAD(whole, 3, '0')", "'AGS 01 001 ' || whole", "''", "NULL",
        )} AS key_text, {_cases(
            "o_orderkey", 5,
            "LPAD(whole, 5, '0')", "'D-' || LPAD(whole, 5, '0') || ' Ort'", "'1234'",
            "'12' || LPAD(whole, 4, '0')", "NULL",
        )} AS plz_text
        FROM (SELECT o_orderkey, o_orderpriority, CAST(o_custkey % 1000 AS STRING) AS whole,
                     LPAD(CAST(o_orderkey % 100 AS STRING), 2, '0') AS cents FROM {{orders}}) x
    """,
    # A census report file: two report rows, a label row, then data rows.
    "fx_report": """
        SELECT c_custkey AS row_no,
               CASE WHEN c_custkey < 2 THEN 'Bericht' WHEN c_custkey = 2 THEN 'Nr'
                    ELSE CAST(c_custkey AS STRING) END AS col_0,
               CASE WHEN c_custkey < 2 THEN NULL WHEN c_custkey = 2 THEN 'GKZ'
                    ELSE LPAD(CAST(c_custkey AS STRING), 8, '0') END AS col_1,
               CASE WHEN c_custkey < 2 THEN NULL WHEN c_custkey = 2 THEN 'Gemeinde'
                    ELSE c_name END AS col_2,
               CASE WHEN c_custkey < 2 THEN NULL WHEN c_custkey = 2 THEN 'Miete'
                    WHEN c_custkey % 7 = 0 THEN '/'
                    ELSE CAST(c_custkey % 40 AS STRING) || ',5' END AS col_3
        FROM {customer}
    """,
    "fx_requests": """
        SELECT o_orderkey AS request_id,
               CASE o_orderkey % 6 WHEN 0 THEN LPAD(CAST(o_custkey % 700 AS STRING), 5, '0')
                    WHEN 1 THEN 'Nation_' || CAST(o_custkey % 25 AS STRING)
                    WHEN 2 THEN 'NATION_' || CAST(o_custkey % 25 AS STRING) || ', Stadt'
                    WHEN 3 THEN o_orderpriority
                    WHEN 4 THEN 'Natoin_' || CAST(o_custkey % 25 AS STRING) END AS city_or_plz,
               CASE o_orderkey % 4 WHEN 0 THEN '2016_plus' WHEN 1 THEN '1950_1959'
                    WHEN 2 THEN '1960_1969' ELSE 'vor_1919' END AS periode
        FROM {orders}
    """,
    "fx_owners": """
        SELECT CAST(s_suppkey AS INT) AS id, s_name AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN LOWER(s_name) || '@example.org' END AS email,
               CAST(NULL AS STRING) AS phone
        FROM {supplier}
    """,
    "fx_properties": """
        SELECT CAST(p_partkey AS INT) AS id,
               CAST(CASE WHEN p_partkey % 97 = 0 THEN -1 ELSE p_partkey % 10 END AS INT) AS owner_id,
               p_name AS street, LPAD(CAST(p_partkey % 700 AS STRING), 5, '0') AS zip_code,
               CASE p_size % 6 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'München' WHEN 2 THEN 'Hamburg'
                    WHEN 3 THEN 'Köln' WHEN 4 THEN 'Frankfurt' ELSE 'Kiel' END AS city,
               CAST(1900 + p_size AS INT) AS year_built
        FROM {part}
    """,
    "fx_units": """
        SELECT CAST(p_partkey AS INT) AS id, CAST(p_partkey AS INT) AS property_id,
               p_brand AS unit_no, CAST(p_size % 7 AS INT) AS floor,
               p_size % 5 + 0.5e0 AS rooms,
               CASE WHEN p_size % 9 = 0 THEN 0.0e0 ELSE p_size * 3.0e0 END AS size_sqm,
               CASE p_partkey % 4 WHEN 0 THEN 'neu' WHEN 1 THEN 'saniert'
                    WHEN 2 THEN 'gebraucht' END AS `condition`
        FROM {part}
    """,
    "fx_tenants": """
        SELECT CAST(c_custkey AS INT) AS id, SUBSTRING(c_name, 1, 8) AS first_name,
               SUBSTRING(c_name, 10, 20) AS last_name, CAST(NULL AS STRING) AS email,
               CASE WHEN c_custkey % 3 = 0 THEN '0431-' || CAST(c_custkey AS STRING) END AS phone
        FROM {customer}
    """,
    "fx_leases": """
        SELECT CAST(o_orderkey AS INT) AS id, CAST(o_orderkey % 200 AS INT) AS unit_id,
               CAST(o_custkey AS INT) AS tenant_id, CAST(o_orderdate AS DATE) AS start_date,
               CAST(NULL AS DATE) AS end_date, o_totalprice / 200.0e0 AS rent_base,
               CASE WHEN o_orderkey % 3 = 0 THEN 0.0e0
                    ELSE o_totalprice / 160.0e0 END AS rent_total,
               CASE WHEN o_orderkey % 4 = 0 THEN 0.0e0 ELSE 1500.0e0 END AS deposit,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS note
        FROM {orders}
    """,
    "fx_payments": """
        SELECT CAST(l_orderkey * 8 + l_linenumber AS INT) AS id, CAST(l_orderkey AS INT) AS lease_id,
               CAST(l_shipdate AS DATE) AS paid_on,
               l_extendedprice / 100.0e0 AS amount, 'rent' AS type,
               CAST(NULL AS STRING) AS note
        FROM {lineitem}
    """,
    # Side costs; a few belong to leases that were never written.
    "fx_charges": """
        SELECT CAST(l_orderkey * 8 + l_linenumber AS INT) AS id,
               CASE WHEN l_orderkey % 53 = 0 THEN CAST(-l_orderkey AS INT)
                    WHEN l_orderkey % 31 <> 0 THEN CAST(l_orderkey AS INT) END AS lease_id,
               SUBSTRING(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS period,
               CASE WHEN l_returnflag = 'R' THEN 'heating' ELSE 'water' END AS type,
               l_extendedprice * l_tax AS amount, CAST(NULL AS STRING) AS note
        FROM {lineitem}
    """,
    "fx_reminders": """
        SELECT CAST(o_orderkey AS INT) AS request_id, CAST(o_orderkey % 250 AS INT) AS unit_id,
               CAST(o_custkey AS INT) AS tenant_id, CAST(o_orderkey % 12 AS INT) AS owner_id,
               SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS period,
               o_totalprice / 8.0e0 AS amount, CAST(o_orderdate AS DATE) AS due_date
        FROM {orders}
    """,
    # Incoming property rows with gaps, as the entry form would see them.
    "fx_entries": """
        SELECT CAST(p_partkey AS INT) AS id,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 10 AS INT) END AS owner_id,
               CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS street,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '12345' END AS zip_code,
               CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'Kiel' END AS city
        FROM {part}
    """,
    "fx_people": """
        SELECT CAST(c_custkey AS INT) AS id,
               CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE SUBSTRING(c_name, 1, 8) END AS first_name,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE SUBSTRING(c_name, 10, 20) END AS last_name
        FROM {customer}
    """,
    "fx_predictions": """
        SELECT o_orderkey AS id, o_totalprice AS y,
               o_totalprice * (0.75e0 + (o_orderkey % 9) / 16.0e0) AS pred
        FROM {orders}
    """,
}


def needed(text: str) -> list[str]:
    """Fixtures a text mentions, each after the ones it builds on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in re.findall(r"\bfx_\w+", SQL[name]):
            visit(other)
        order.append(name)

    for name in re.findall(r"\bfx_\w+", text):
        visit(name)
    return order


def with_fixtures(body: str) -> str:
    """The statement with every fixture it needs put in front as a common table."""
    tables = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed(body))
    body = body.strip()
    if not tables:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{tables},\n{body[len(start):]}"
    return f"WITH {tables}\n{body}"


def oracle_text(body: str) -> str:
    """The statement for the checking engine, on tables of the same name."""
    text = with_fixtures(body).replace("`", '"')
    return TABLE_MARK.sub(r"\1", text)


# Schemas read once per file, so that later queries need no footer job.
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The given tables and the fixtures derived from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def sql(self, body: str) -> DataFrame:
        text = with_fixtures(body)
        used = {name: self.base(name) for name in set(TABLE_MARK.findall(text))}
        return self.spark.sql(text, **used) if used else self.spark.sql(text)

    def fx(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM fx_{name}")
