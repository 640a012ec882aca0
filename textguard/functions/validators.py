"""Checks a matched value must pass before it counts as personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Checksum over the 13 to 19 digits of a card number."""
    digits = digits_of(value)
    weighted = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, F.ascii(d) - 48).otherwise(
            (F.ascii(d) - 48) * 2 - F.when(d > "4", 9).otherwise(0)
        ),
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + d)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def ssn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[-. ]", "")
    area, group, serial = (F.substring(digits, *at) for at in ((1, 3), (4, 2), (6, 4)))
    return (
        (F.length(digits) == 9)
        & ~area.isin("000", "666")
        & ~area.startswith("9")
        & (group != "00")
        & (serial != "0000")
    )


def email(value: Column) -> Column:
    at = F.instr(value, "@")
    domain = F.substring_index(value, "@", -1)
    return (at >= 2) & (at <= F.length(value) - 2) & domain.contains(".") & (F.length(domain) >= 3)


def phone(value: Column) -> Column:
    return F.length(digits_of(value)) >= 10


def ipv4(value: Column) -> Column:
    return F.size(F.split(value, "\\.")) == 4


def plausible(category: Column, value: Column) -> Column:
    """The check of each category; the others only need three characters."""
    return (
        F.when(category == "ssn", ssn(value))
        .when(category == "credit_card", luhn(value))
        .when(category == "email", email(value))
        .when(category == "phone", phone(value))
        .when(category == "ip_address", ipv4(value))
        .otherwise(F.octet_length(value) >= 3)
    )
