"""Maturity labels: parsing, ordering and canonical spelling as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings and how many of the unit make a year.
POINT_FORM = r"^Y(\d+)P(\d+)$"
UNIT_FORMS = (
    (r"^(\d+(?:\.\d+)?)\s*Y(?:R|RS|EAR|EARS)?$", 1.0),
    (r"^(\d+(?:\.\d+)?)\s*M(?:O|OS|ONTH|ONTHS)?$", 12.0),
    (r"^(\d+(?:\.\d+)?)\s*W(?:K|KS|EEK|EEKS)?$", 52.0),
    (r"^(\d+(?:\.\d+)?)\s*D(?:AY|AYS)?$", 365.0),
)


_PER_YEAR = {"Y": 1.0, "M": 12.0, "W": 52.0, "D": 365.0}
_UNITS = r"^(\d+(?:\.\d+)?)\s*(?:(Y)(?:R|RS|EAR|EARS)?|(M)(?:O|OS|ONTH|ONTHS)?|(W)(?:K|KS|EEK|EEKS)?|(D)(?:AY|AYS)?)$"


def term_years(label: Column) -> Column:
    """Maturity in years, null when the label is not a maturity.

    Both spellings are first rewritten to "<amount> <unit>", so the label is
    matched twice whatever the number of units.
    """
    text = F.upper(F.trim(label.cast("string")))
    plain = F.regexp_replace(F.regexp_replace(text, POINT_FORM, "$1.$2Y"), _UNITS, "$1 $2$3$4$5")
    parts = F.split(plain, " ")
    per_year = F.create_map(*[F.lit(v) for pair in _PER_YEAR.items() for v in pair])
    return F.when(
        plain.rlike(r"^\d+(\.\d+)? [YMWD]$"),
        parts[0].try_cast("double") / per_year[parts[1]],
    )


def years_of_name(name: str) -> float | None:
    """The same rule for a column *name*, used when reading a schema."""
    text = str(name).strip().upper()
    point = re.match(POINT_FORM, text)
    if point:
        return float(f"{point[1]}.{point[2]}")
    for pattern, per_year in UNIT_FORMS:
        hit = re.match(pattern, text)
        if hit:
            return float(hit[1]) / per_year
    return None


def term_order(label: Column) -> list[Column]:
    """Sort columns: by years, then labels that are no maturity, by name."""
    years = term_years(label)
    return [years.isNull().asc(), years.asc_nulls_last(), label.asc()]


def canonical_term(label: Column) -> Column:
    """'<years>Y' with six significant digits and no trailing zeros."""
    years = term_years(label)
    whole = F.floor(F.log10(F.greatest(years, F.lit(1e-300)))) + 1
    digits = F.greatest(F.lit(0), 6 - whole).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    kept = F.round(years * scale) / scale
    text = F.format_string("%.12f", kept)
    trimmed = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(years.isNotNull(), F.concat(trimmed, F.lit("Y")))
