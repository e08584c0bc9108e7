"""Master-data reports, entry rules, integrity, reminder letters."""

from __future__ import annotations


from rentlens.catalog.registry import query
from rentlens.operators import reports


@query(
    "M1_owner_list",
    'SELECT id AS `ID`, name AS `Name`, email AS `E-Mail`, phone AS `Telefon` FROM fx_owners',
)
def owners(t):
    return reports.owner_list(t.fx("owners"))


@query(
    "M1_property_list",
    """SELECT id AS `ID`, owner_id AS `Eigentümer`, street || ', ' || zip_code || ' ' || city
              AS `Adresse`, year_built AS `Baujahr` FROM fx_properties""",
)
def properties(t):
    return reports.property_list(t.fx("properties"))


@query(
    "M1_unit_list",
    """SELECT id AS `ID`, property_id AS `Objekt`, unit_no AS `Whg`, floor AS `Etage`,
              rooms AS `Zimmer`, size_sqm AS `m²`, `condition` AS `Zustand` FROM fx_units""",
)
def units(t):
    return reports.unit_list(t.fx("units"))


@query(
    "M1_tenant_list",
    """SELECT id AS `ID`, first_name || ' ' || last_name AS `Name`, email AS `E-Mail`,
              phone AS `Telefon` FROM fx_tenants""",
)
def tenants(t):
    return reports.tenant_list(t.fx("tenants"))


@query(
    "M2_lease_list",
    """SELECT id AS `ID`, unit_id AS `Whg`, tenant_id AS `Mieter`, start_date AS `Start`,
              end_date AS `Ende`, rent_base AS `Kalt (€)`, nullif(rent_total, 0) AS `Warm (€)`
       FROM fx_leases""",
)
def leases(t):
    return reports.lease_list(reports.normalize_lease_input(t.fx("leases")))


@query(
    "M2_payment_list",
    """SELECT id AS `ID`, lease_id AS `Vertrag`, paid_on AS `Datum`, amount AS `Betrag`, type AS `Typ`,
              note AS `Notiz` FROM fx_payments""",
)
def payments(t):
    return reports.payment_list(t.fx("payments"))


@query(
    "M3_reminder_letters",
    """SELECT request_id,
       'Betreff: Zahlungserinnerung – Wohnung ' || coalesce(unit_no, '') || ', '
       || coalesce(street, '') || ', ' || coalesce(zip_code, '') || ' ' || coalesce(city, '')
       || chr(10) || chr(10) || 'Sehr geehrte/r ' || coalesce(first_name || ' ' || last_name, '')
       || ',' || chr(10) || chr(10) || 'für den Mietzeitraum ' || period
       || ' ist bisher kein Zahlungseingang verzeichnet.' || chr(10) || 'Offener Betrag: '
       || printf('%.2f', amount) || ' €.' || chr(10) || chr(10)
       || 'Bitte überweisen Sie den Betrag bis spätestens ' || strftime(due_date, '%d.%m.%Y')
       || ' auf das bekannte Konto.' || chr(10) || chr(10) || 'Mit freundlichen Grüßen' || chr(10)
       || coalesce(o.name, '') AS letter
       FROM fx_reminders r LEFT JOIN fx_units u ON r.unit_id = u.id
       LEFT JOIN fx_properties p ON u.property_id = p.id
       LEFT JOIN fx_tenants te ON r.tenant_id = te.id LEFT JOIN fx_owners o ON r.owner_id = o.id""",
)
def letters(t):
    written = reports.reminder_letters(
        t.fx("reminders"), t.fx("units"), t.fx("properties"), t.fx("tenants"), t.fx("owners")
    )
    return written.select("request_id", "letter")


@query(
    "M4_validate_master_data",
    """SELECT id, concat_ws(',', CASE WHEN owner_id IS NULL THEN 'owner_id' END,
              CASE WHEN coalesce(street, '') = '' THEN 'street' END,
              CASE WHEN coalesce(zip_code, '') = '' THEN 'zip_code' END,
              CASE WHEN coalesce(city, '') = '' THEN 'city' END) AS missing,
              owner_id IS NOT NULL AND coalesce(street, '') <> '' AND coalesce(zip_code, '') <> ''
              AND coalesce(city, '') <> '' AS accepted
       FROM fx_entries""",
)
def entries(t):
    checked = reports.validate_master_data(t.fx("entries"), "properties")
    return checked.select("id", "missing", "accepted")


@query(
    "M4_rejected_tenants",
    """SELECT id, concat_ws(',', CASE WHEN trim(coalesce(first_name, '')) = '' THEN 'first_name' END,
              CASE WHEN trim(coalesce(last_name, '')) = '' THEN 'last_name' END) AS missing
       FROM fx_people
       WHERE trim(coalesce(first_name, '')) = '' OR trim(coalesce(last_name, '')) = ''""",
)
def people(t):
    return reports.rejected_rows(t.fx("people"), "tenants").select("id", "missing")


@query(
    "M5_normalize_lease_input",
    """SELECT id, nullif(rent_total, 0) AS rent_total, nullif(deposit, 0) AS deposit,
              nullif(note, '') AS note FROM fx_leases""",
)
def lease_input(t):
    return reports.normalize_lease_input(
        t.fx("leases").select("id", "rent_total", "deposit", "note")
    )


@query(
    "G14_unit_context",
    """SELECT u.id, unit_no, street, zip_code, city, year_built FROM fx_units u
       LEFT JOIN fx_properties p ON u.property_id = p.id""",
)
def unit_context(t):
    return reports.unit_context(t.fx("units"), t.fx("properties")).select(
        "id", "unit_no", "street", "zip_code", "city", "year_built"
    )


_KEYS = [
    ("properties", "owner_id", "owners"), ("units", "property_id", "properties"),
    ("leases", "unit_id", "units"), ("leases", "tenant_id", "tenants"),
    ("payments", "lease_id", "leases"), ("charges", "lease_id", "leases"),
]


@query(
    "G16_orphan_rows",
    " UNION ALL ".join(
        f"SELECT '{child}' AS child, '{fk}' AS fk, CAST(c.{fk} AS BIGINT) AS `key` "
        f"FROM fx_{child} c WHERE c.{fk} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM fx_{parent} p WHERE p.id = c.{fk})"
        for child, fk, parent in _KEYS
    ),
)
def orphans(t):
    names = ["owners", "properties", "units", "tenants", "leases", "payments", "charges"]
    return reports.orphan_rows({name: t.fx(name) for name in names})
