"""Spanish tax ids: cleaning, format, checksum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def clean_tax_id(c: Column, dots: bool = False) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-.]" if dots else r"(?U)[\s\-]", ""))


def tax_id_format(c: Column) -> Column:
    v = clean_tax_id(c, dots=True)
    return (
        F.when(v.rlike(K.CIF_FORMAT), "CIF").when(v.rlike(K.NIF_FORMAT), "NIF").when(v.rlike(K.NIE_FORMAT), "NIE")
    )


def loose_format_ok(c: Column) -> Column:
    """Letter, seven digits and a control character."""
    return F.coalesce(F.upper(F.trim(c)).rlike(K.LOOSE_ID_FORMAT), F.lit(False))


def _letter_ok(number: Column, letter: Column) -> Column:
    return letter == F.substring(F.lit(K.NIF_LETTERS), (number.try_cast("int") % 23) + 1, F.lit(1))


def _cif_control(digits: Column) -> Column:
    """Control digit of the seven digits of a CIF: odd places doubled with digits added up."""
    def digit(i: int) -> Column:
        return F.substring(digits, i, 1).try_cast("int")

    def doubled(i: int) -> Column:
        twice = digit(i) * 2
        return twice - F.when(twice >= 10, 9).otherwise(0)

    total = digit(2) + digit(4) + digit(6) + doubled(1) + doubled(3) + doubled(5) + doubled(7)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def valid_clean_id(v: Column) -> Column:
    """Checksum of an id that is already cleaned and upper-case."""
    nie_digits = F.concat(F.translate(F.substring(v, 1, 1), "XYZ", "012"), F.substring(v, 2, 7))
    control = _cif_control(F.substring(v, 2, 7))
    last = F.substring(v, 9, 1)
    cif = (last == control.cast("string")) | (
        last == F.substring(F.lit(K.CIF_CONTROL_LETTERS), control + 1, F.lit(1))
    )
    return F.coalesce(
        F.when(v.rlike(K.NIF_FORMAT), _letter_ok(F.substring(v, 1, 8), last))
        .when(v.rlike(K.NIE_FORMAT), _letter_ok(nie_digits, last))
        .when(v.rlike(K.CIF_CHECKED_FORMAT), cif)
        .otherwise(False),
        F.lit(False),
    )


def tax_id_valid(c: Column) -> Column:
    return valid_clean_id(clean_tax_id(c))
