"""Master-data reports, integrity checks, entry rules and reminder letters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import parsing
from rentlens.functions import text as tx
from rentlens.operators.joins import lookup_join
from rentlens.schemas import FOREIGN_KEYS

# Fixed value: the reminder text with its placeholders.
REMINDER = """Betreff: Zahlungserinnerung – Wohnung {{ unit_no }}, {{ street }}, {{ zip }} {{ city }}

Sehr geehrte/r {{ tenant_name }},

für den Mietzeitraum {{ period }} ist bisher kein Zahlungseingang verzeichnet.
Offener Betrag: {{ amount }} €.

Bitte überweisen Sie den Betrag bis spätestens {{ due_date }} auf das bekannte Konto.

Mit freundlichen Grüßen
{{ owner_name }}
"""

# Text fields the entry forms require per table.
REQUIRED = {
    "owners": ["name"],
    "properties": ["owner_id", "street", "zip_code", "city"],
    "units": ["property_id", "unit_no"],
    "tenants": ["first_name", "last_name"],
}


def owner_list(owners: DataFrame) -> DataFrame:
    return owners.select(
        F.col("id").alias("ID"),
        F.col("name").alias("Name"),
        F.col("email").alias("E-Mail"),
        F.col("phone").alias("Telefon"),
    )


def property_list(properties: DataFrame) -> DataFrame:
    return properties.select(
        F.col("id").alias("ID"),
        F.col("owner_id").alias("Eigentümer"),
        parsing.address_label(F.col("street"), F.col("zip_code"), F.col("city")).alias("Adresse"),
        F.col("year_built").alias("Baujahr"),
    )


def unit_list(units: DataFrame) -> DataFrame:
    return units.select(
        F.col("id").alias("ID"),
        F.col("property_id").alias("Objekt"),
        F.col("unit_no").alias("Whg"),
        F.col("floor").alias("Etage"),
        F.col("rooms").alias("Zimmer"),
        F.col("size_sqm").alias("m²"),
        F.col("condition").alias("Zustand"),
    )


def tenant_list(tenants: DataFrame) -> DataFrame:
    return tenants.select(
        F.col("id").alias("ID"),
        parsing.person_label(F.col("first_name"), F.col("last_name")).alias("Name"),
        F.col("email").alias("E-Mail"),
        F.col("phone").alias("Telefon"),
    )


def lease_list(leases: DataFrame) -> DataFrame:
    return leases.select(
        F.col("id").alias("ID"),
        F.col("unit_id").alias("Whg"),
        F.col("tenant_id").alias("Mieter"),
        F.col("start_date").alias("Start"),
        F.col("end_date").alias("Ende"),
        F.col("rent_base").alias("Kalt (€)"),
        F.col("rent_total").alias("Warm (€)"),
    )


def payment_list(payments: DataFrame) -> DataFrame:
    return payments.select(
        F.col("id").alias("ID"),
        F.col("lease_id").alias("Vertrag"),
        F.col("paid_on").alias("Datum"),
        F.col("amount").alias("Betrag"),
        F.col("type").alias("Typ"),
        F.col("note").alias("Notiz"),
    )


def unit_context(units: DataFrame, properties: DataFrame) -> DataFrame:
    """Units with the address of their property; units without one are kept."""
    address = properties.select(
        F.col("id").alias("property_id"),
        "owner_id", "street", "zip_code", "city", "year_built",
    )
    return lookup_join(units, address, ["property_id"])


def orphan_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose foreign key has no parent, for every declared key among ``tables``."""
    found = []
    for child, column, parent in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        keys = tables[child].select(F.col(column).cast("long").alias("key")).where("key is not null")
        parents = tables[parent].select(F.col("id").cast("long").alias("key")).distinct()
        orphans = lookup_join(keys, parents, ["key"], "left_anti")
        found.append(
            orphans.select(F.lit(child).alias("child"), F.lit(column).alias("fk"), "key")
        )
    return reduce(DataFrame.unionByName, found)


def validate_master_data(df: DataFrame, table: str) -> DataFrame:
    """Entry rules of a table: names of the missing fields and an accepted flag.

    A person or owner name made of blanks counts as missing; other text only when empty.
    """
    checks = []
    for column in REQUIRED[table]:
        text = F.col(column).cast("string")
        if table in ("owners", "tenants"):
            text = tx.strip(text)
        given = F.coalesce(text != "", F.lit(False))
        checks.append(F.when(~given, F.lit(column)))
    missing = F.array_join(F.array_compact(F.array(*checks)), ",")
    return df.withColumn("missing", missing).withColumn("accepted", F.col("missing") == "")


def accepted_rows(df: DataFrame, table: str) -> DataFrame:
    return validate_master_data(df, table).where("accepted").drop("missing", "accepted")


def rejected_rows(df: DataFrame, table: str) -> DataFrame:
    return validate_master_data(df, table).where("not accepted").drop("accepted")


def normalize_lease_input(df: DataFrame) -> DataFrame:
    """Zero rents and deposits and empty optional texts become null."""
    changes = {
        c: F.nullif(F.col(c), F.lit(0.0)) for c in ("rent_total", "deposit") if c in df.columns
    }
    for c in ("note", "email", "phone", "condition"):
        if c in df.columns:
            changes[c] = F.nullif(F.col(c), F.lit(""))
    return df.withColumns(changes)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Text with each ``{{ name }}`` replaced; null values and unknown names stay empty.

    The template is cut at its placeholders while planning, so text inside a value is
    never read as a placeholder. One newline at the very end is dropped.
    """
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template.removesuffix("\n"))
    cells = [
        F.coalesce(values[part], F.lit("")) if i % 2 and part in values else F.lit(part)
        for i, part in enumerate(parts)
        if not (i % 2 and part not in values)
    ]
    return F.concat(*cells)


def reminder_letters(
    requests: DataFrame,
    units: DataFrame,
    properties: DataFrame,
    tenants: DataFrame,
    owners: DataFrame,
    template: str = REMINDER,
) -> DataFrame:
    """One letter per request row; unknown units, tenants or owners leave empty places."""
    unit = units.select(F.col("id").alias("unit_id"), "unit_no", "property_id")
    house = properties.select(F.col("id").alias("property_id"), "street", "zip_code", "city")
    person = tenants.select(
        F.col("id").alias("tenant_id"),
        parsing.person_label(F.col("first_name"), F.col("last_name")).alias("tenant_name"),
    )
    owner = owners.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"))
    joined = lookup_join(requests, lookup_join(unit, house, ["property_id"]), ["unit_id"])
    joined = lookup_join(joined, person, ["tenant_id"])
    joined = lookup_join(joined, owner, ["owner_id"])
    values = {
        "unit_no": F.col("unit_no"),
        "street": F.col("street"),
        "zip": F.col("zip_code"),
        "city": F.col("city"),
        "tenant_name": F.col("tenant_name"),
        "period": F.col("period"),
        "amount": parsing.format_amount(F.col("amount")),
        "due_date": parsing.format_date_de(F.col("due_date")),
        "owner_name": F.col("owner_name"),
    }
    return joined.select(*requests.columns, fill_template(template, values).alias("letter"))
