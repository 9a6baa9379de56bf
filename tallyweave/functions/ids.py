"""Checksums of account numbers and tax ids: Column builders, evaluated by Spark without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IBAN lengths (ISO 13616) and VAT number formats by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BH": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KW": 30, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "OM": 23, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
VAT = {
    "AT": r"ATU\d{8}", "BE": r"BE[01]\d{9}", "DE": r"DE\d{9}", "DK": r"DK\d{8}", "ES": r"ES[A-Z0-9]\d{7}[A-Z0-9]", "FI": r"FI\d{8}",
    "FR": r"FR[A-Z0-9]{2}\d{9}", "GB": r"GB(\d{9}|\d{12}|GD\d{3}|HA\d{3})", "IE": r"IE\d[A-Z0-9+*]\d{5}[A-Z]{1,2}", "IT": r"IT\d{11}",
    "NL": r"NL\d{9}B\d{2}", "PL": r"PL\d{10}", "PT": r"PT\d{9}", "SE": r"SE\d{12}", "LU": r"LU\d{8}",
}
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s.\-]", ""))


def _mod97(s: Column) -> Column:
    """Letters count as two digits; the remainder is carried along."""
    step = lambda a, ch: F.when(F.rlike(ch, F.lit("[0-9]")), (a * 10 + ch.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)
    return F.aggregate(F.filter(F.split(s, ""), lambda ch: ch != ""), F.lit(0), step)


def _length_of(country: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in IBAN_LENGTH.items() for x in kv))[country]


def _shaped(s: Column) -> Column:
    return F.rlike(s, F.lit(r"^[A-Z]{2}\d{2}[A-Z0-9]{8,30}$"))


def looks_like_iban(c: Column) -> Column:
    s = compact(c)
    return F.coalesce(_shaped(s) & (_length_of(F.left(s, F.lit(2))) == F.length(s)), F.lit(False))


def iban_valid(c: Column) -> Column:
    """The shape, the length where the country is known, and the checksum."""
    s = compact(c)
    fits = F.coalesce(_length_of(F.left(s, F.lit(2))) == F.length(s), F.lit(True))
    return F.when(_shaped(s) & fits, _mod97(F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))) == 1).otherwise(False)


def make_iban(country: Column, bban: Column) -> Column:
    check = 98 - _mod97(F.concat(bban, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), bban)


def gstin_check_char(first14: Column) -> Column:
    """Weights 1 and 2 in turn over base-36 digits."""
    digits = F.transform(F.slice(F.split(first14, ""), 1, 14), lambda ch: F.when(F.rlike(ch, F.lit("[0-9]")), ch.try_cast("int")).otherwise(F.ascii(ch) - 55))
    parts = F.transform(digits, lambda v, i: v * (i % 2 + 1))
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + F.floor(p / 36).cast("int") + p % 36)
    return F.substr(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))


def tax_id(c: Column) -> Column:
    """struct(kind, value, valid) of a tax id; the kind follows from its form."""
    v = F.upper(F.regexp_replace(c, r"(?U)\s", ""))
    plain = F.regexp_replace(v, r"[.\-]", "")
    state = F.left(v, F.lit(2)).try_cast("int")
    gstin = F.rlike(v, F.lit(r"^\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]$")) & (state.between(1, 38) | state.isin(97, 99))
    gstin = F.when(gstin, gstin_check_char(F.left(v, F.lit(14))) == F.right(v, F.lit(1))).otherwise(False)
    vat = F.lit(False)
    for country, pattern in VAT.items():
        vat = F.when(F.startswith(plain, F.lit(country)), F.rlike(plain, F.lit(f"^({pattern})$"))).otherwise(vat)
    out = lambda kind, value, valid: F.struct(F.lit(kind).alias("kind"), value.alias("value"), valid.alias("valid"))
    return (
        F.when(F.rlike(v, F.lit(r"^\d{2}[A-Z0-9]{13}$")) & ~F.rlike(v, F.lit(r"^\d+$")), out("GSTIN", v, gstin))
        .when(F.rlike(v, F.lit(r"^\d{15}$")), out("UAE_TRN", v, F.startswith(v, F.lit("100"))))
        .when(F.rlike(v, F.lit("^[A-Z]{2}")), out("EU_VAT", plain, vat))
        .otherwise(out("UNKNOWN", v, F.lit(False)))
    )


def same_tax_id(a: Column, b: Column) -> Column:
    """Letters and digits agree, a prefix of one or two letters aside; missing ids agree with any."""
    x, y = (F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "") for c in (a, b))
    bare = lambda s: F.regexp_replace(s, "^[A-Z]{1,2}", "")
    return (x == "") | (y == "") | (x == y) | (bare(x) == bare(y))


def same_account(a: Column, b: Column) -> Column:
    """Accounts agree; a bank code (IFSC, after a space and a slash or in brackets) counts where both have one."""
    number = lambda c: compact(F.regexp_replace(c, r"(?i)\(?\b[A-Z]{4}0[A-Z0-9]{6}\b\)?|/|ifsc", ""))
    code = lambda c: F.nullif(F.upper(F.regexp_extract(c, r"(?i)\b([A-Z]{4}0[A-Z0-9]{6})\b", 1)), F.lit(""))
    return (number(a) == number(b)) & F.coalesce(code(a) == code(b), F.lit(True))
