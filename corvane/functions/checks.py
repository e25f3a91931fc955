"""Check digits as native column expressions; each takes a string and is false for anything malformed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The dihedral group's multiplication table and the permutation by place, as rows of digits.
VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def _digits(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _at(table: list[str], row: Column, place: Column) -> Column:
    return F.substring(F.lit("".join(table)), row * 10 + place + 1, F.lit(1)).cast("int")


def luhn(text: Column) -> Column:
    return text.rlike("^[0-9]{2,}$") & F.coalesce(F.call_function("luhn_check", text), F.lit(False))


def verhoeff(text: Column) -> Column:
    places = F.reverse(_digits(F.when(text.rlike("^[0-9]+$"), text).otherwise("1")))
    pairs = F.transform(places, lambda d, i: F.struct(d.cast("int").alias("d"), (i % 8).alias("i")))
    check = F.aggregate(pairs, F.lit(0), lambda c, p: _at(VERHOEFF_D, c, _at(VERHOEFF_P, p["i"], p["d"])))
    return text.rlike("^[0-9]+$") & (check == 0)


def iban(text: Column) -> Column:
    """Letters count 10 to 35; the number, its first four characters at the end, is 1 modulo 97."""
    plain = F.upper(F.regexp_replace(text, r"\s", ""))
    good = plain.rlike("^[A-Z0-9]{15,34}$")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    chars = _digits(F.when(good, moved).otherwise("0"))
    rest = F.aggregate(chars, F.lit(0), lambda r, c: ((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))
    return good & (rest == 1)


def aba(text: Column) -> Column:
    """Nine digits weighted 3, 7, 1 add up to a multiple of ten."""
    good = text.rlike("^[0-9]{9}$")
    weights = F.array(*map(F.lit, [3, 7, 1] * 3))
    total = F.aggregate(F.zip_with(_digits(F.when(good, text).otherwise("000000000")), weights, lambda d, w: d.cast("int") * w), F.lit(0), lambda s, x: s + x)
    return good & (total % 10 == 0)
