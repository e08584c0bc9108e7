from __future__ import annotations

import datetime

from rentlens.operators import reports


def test_letters_fill_any_template(spark):
    units = spark.createDataFrame([(1, "W1", 10), (2, "W2", 99)], "id int, unit_no string, property_id int")
    houses = spark.createDataFrame([(10, "Weg {{ city }} 1", "24103", "Kiel")],
                                   "id int, street string, zip_code string, city string")
    tenants = spark.createDataFrame([(5, "Ada", "Ber")], "id int, first_name string, last_name string")
    owners = spark.createDataFrame([(7, "Cy")], "id int, name string")
    due = datetime.date(2025, 9, 30)
    requests = spark.createDataFrame(
        [(1, 5, 7, "2025-09", 900.0, due), (2, 6, 8, "2025-10", 1233.695, due)],
        "unit_id int, tenant_id int, owner_id int, period string, amount double, due_date date",
    )
    text = {r.unit_id: r.letter for r in reports.reminder_letters(
        requests, units, houses, tenants, owners).collect()}
    assert text[1].startswith("Betreff: Zahlungserinnerung – Wohnung W1, Weg {{ city }} 1, 24103 Kiel\n\n")
    assert "Offener Betrag: 900.00 €." in text[1] and "30.09.2025" in text[1] and text[1].endswith("\nCy")
    assert "Wohnung W2, ,  \n" in text[2] and "Sehr geehrte/r ,\n" in text[2] and "1233.69 €" in text[2]
    short = reports.reminder_letters(requests, units, houses, tenants, owners, "{{period}}|{{ what }}|{{ amount }}")
    assert {r.letter for r in short.collect()} == {"2025-09||900.00", "2025-10||1233.69"}


def test_entry_rules(spark):
    df = spark.createDataFrame([(1, " "), (2, "x"), (3, None)], "id int, name string")
    checked = {r.id: (r.missing, r.accepted) for r in reports.validate_master_data(df, "owners").collect()}
    assert checked == {1: ("name", False), 2: ("", True), 3: ("name", False)}
    assert reports.accepted_rows(df, "owners").count() == 1
    assert reports.rejected_rows(df, "owners").count() == 2


def test_orphans(spark):
    owners = spark.createDataFrame([(1,)], "id int")
    houses = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "id int, owner_id int")
    found = reports.orphan_rows({"owners": owners, "properties": houses}).collect()
    assert [tuple(r) for r in found] == [("properties", "owner_id", 5)]


def test_lease_input(spark):
    df = spark.createDataFrame([(0.0, 5.0, ""), (3.0, 0.0, "n")], "rent_total double, deposit double, note string")
    got = [tuple(r) for r in reports.normalize_lease_input(df).collect()]
    assert got == [(None, 5.0, None), (3.0, None, "n")]
