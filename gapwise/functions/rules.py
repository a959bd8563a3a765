"""Business rules as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (count, minimum) columns of the staff cadres, as the input names them.
CADRES = [("med_officers", "min_medical_officers"), ("nurses_midwives", "min_nurses_midwives"), ("chews", "min_chews"), ("lab_scientists", "min_lab_scientists"), ("pharm_techs", "min_pharmacy_technicians")]

#: The kinds of gaps that ``gap_type`` gives.
GAP_TYPES = ["adequately_served", "facility_present_understaffed", "facility_absent"]


def adequacy(known_type: Column, has_record: Column, cadres=CADRES) -> Column:
    """unknown_facility_type, no_personnel_record, inadequate, adequate; the first that holds.

    A cadre counts only if its minimum is not zero; a missing count passes.
    """
    short = reduce(lambda a, b: a | b, [F.coalesce((F.col(m) > 0) & (F.col(c) < F.col(m)), F.lit(False)) for c, m in cadres])
    return F.when(~known_type, "unknown_facility_type").when(~has_record, "no_personnel_record").when(short, "inadequate").otherwise("adequate")


def gap_type(adequate: Column, any_facility: Column, threshold: float = 60.0) -> Column:
    """By minutes that are already rounded; missing minutes are not served."""
    return F.when(adequate <= threshold, "adequately_served").when(any_facility <= threshold, "facility_present_understaffed").otherwise("facility_absent")


def dose(card_seen: Column, on_card: Column, by_caregiver: Column) -> Column:
    """The card's entry if the card was seen, blank or not; else the caregiver's word."""
    return F.when(card_seen == "Yes", on_card).otherwise(by_caregiver)


def check_digit(digits: Column) -> Column:
    """The check character of a text of digits: modulus 11, weights 2 to 7 from right to left and again, 10 is X.

    The weighted sum with the check value added is a multiple of 11. A null or
    anything but digits gives null.
    """
    each = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    total = F.aggregate(F.transform(each, lambda c, i: c.cast("int") * (i % 6 + 2)), F.lit(0), lambda a, b: a + b)
    value = (11 - total % 11) % 11
    return F.when(digits.rlike("^[0-9]+$"), F.when(value == 10, "X").otherwise(value.cast("string")))
