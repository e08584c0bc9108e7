"""Fixed table schemas. Keys such as PLZ, ARS and AGS are always text."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from rentlens.functions.features import PERIOD_COLUMNS, SIZE_COLUMNS

TEXT, INT, DOUBLE, DATE = StringType(), IntegerType(), DoubleType(), DateType()


def _table(required: dict, optional: dict | None = None) -> StructType:
    fields = [StructField(name, kind, False) for name, kind in required.items()]
    fields += [StructField(name, kind, True) for name, kind in (optional or {}).items()]
    return StructType(fields)


def strings(names: list[str]) -> StructType:
    """All-text schema for raw files."""
    return StructType([StructField(name, TEXT) for name in names])


OWNERS = _table({"id": INT, "name": TEXT}, {"email": TEXT, "phone": TEXT})
PROPERTIES = _table(
    {"id": INT, "owner_id": INT, "street": TEXT, "zip_code": TEXT, "city": TEXT},
    {"year_built": INT},
)
UNITS = _table(
    {"id": INT, "property_id": INT, "unit_no": TEXT},
    {"floor": INT, "rooms": DOUBLE, "size_sqm": DOUBLE, "heating_type": TEXT, "condition": TEXT},
)
TENANTS = _table(
    {"id": INT, "first_name": TEXT, "last_name": TEXT}, {"email": TEXT, "phone": TEXT}
)
LEASES = _table(
    {"id": INT, "unit_id": INT, "tenant_id": INT, "start_date": DATE, "rent_base": DOUBLE},
    {"end_date": DATE, "rent_total": DOUBLE, "deposit": DOUBLE},
)
PAYMENTS = _table(
    {"id": INT, "lease_id": INT, "paid_on": DATE, "amount": DOUBLE, "type": TEXT}, {"note": TEXT}
)
CHARGES = _table(
    {"id": INT, "lease_id": INT, "period": TEXT, "type": TEXT, "amount": DOUBLE}, {"note": TEXT}
)
LISTINGS_RAW = _table(
    {},
    {
        "id": INT, "source": TEXT, "city": TEXT, "zip_code": TEXT, "district": TEXT,
        "lat": DOUBLE, "lon": DOUBLE, "area_sqm": DOUBLE, "rooms": DOUBLE, "floor": DOUBLE,
        "year_built": INT, "condition": TEXT, "rent_warm": DOUBLE, "rent_cold": DOUBLE,
        "created_at": TEXT, "extra_json": TEXT,
    },
)
ZENSUS_0004 = strings(["GKZ", "Gemeindename", "Miete_raw"])
ZENSUS_0005 = strings(["GKZ", "Gemeindename", "Insgesamt", *PERIOD_COLUMNS])
ZENSUS_0008 = strings(["GKZ", "Gemeindename", "Insgesamt", *SIZE_COLUMNS])
KEY_MAP = strings(["ARS", "AGS", "Gemeindename", "PLZ", "Ort"])

# Foreign keys as (child table, child column, parent table).
FOREIGN_KEYS = [
    ("properties", "owner_id", "owners"),
    ("units", "property_id", "properties"),
    ("leases", "unit_id", "units"),
    ("leases", "tenant_id", "tenants"),
    ("payments", "lease_id", "leases"),
    ("charges", "lease_id", "leases"),
]
