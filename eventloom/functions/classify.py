"""Line classification, rarity labels and time baskets, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.rules import RULES

#: Last bank of each range and its label; higher banks are unknown.
BANKS = [(6, "HW_CPU_CORE"), (15, "HW_FABRIC_INT"), (23, "HW_MEM_DIMM"), (31, "HW_PCIE_HUB"), (47, "HW_FABRIC_RTR"), (63, "HW_IF_GPU_LINK")]
BANK_UNKNOWN = "HW_MCE_UNK"
BANK = r"(?:Bank\s*|MC)(\d+)(?:_STATUS)?"
#: Lowest count of each rarity label.
RARITY = [("ULTRA_RARE", 0), ("RARE", 500), ("MODERATE", 5_000), ("COMMON", 50_000), ("VERY_COMMON", 500_000)]
RARITY_END = 10**12


def bank_label(line: Column) -> Column:
    """Label of the first bank number in a line, null where there is none; a number too long for a BIGINT is unknown."""
    digits = F.regexp_extract(line, BANK, 1)
    bank = digits.try_cast("bigint")
    label = F.lit(BANK_UNKNOWN)
    for last, name in reversed(BANKS):  # null compares as false, so overflow falls to unknown
        label = F.when(bank <= last, name).otherwise(label)
    return F.when(digits != "", label)


def is_machine_check(line: Column) -> Column:
    return line.contains("Machine Check") | (line.contains("MC") & line.contains("_STATUS"))


def java_pattern(pattern: str, ignore_case: bool) -> str:
    """Flags under which a Java pattern reads text as the rules were written for: only \\n ends a line, classes and case are Unicode."""
    return ("(?diuU)" if ignore_case else "(?dU)") + pattern


def classify(line: Column, rules: list[tuple[str, str, bool]] = RULES) -> Column:
    """Label of a line: the bank of a machine check, else the first rule that matches, else null.

    One chained CASE over the line, evaluated in order and stopping at the first
    match. Refer to the result once, or write it out: a second reference may
    work the chain out again.
    """
    matched = F.lit(None).cast("string")
    for label, pattern, ignore_case in reversed(rules):
        matched = F.when(line.rlike(java_pattern(pattern, ignore_case)), label).otherwise(matched)
    return F.when((line != "") & line.isNotNull(), F.coalesce(F.when(is_machine_check(line), bank_label(line)), matched))


def dataset_type(event_token: Column) -> Column:
    return F.when(event_token.isNotNull(), "parsed_logs").otherwise("residuals")


def rarity(count: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, least in RARITY:
        label = F.when(count >= least, name).otherwise(label)
    return F.when(count < RARITY_END, label).otherwise(RARITY[-1][0])


#: Time baskets: first basket, first second, width in seconds, number of baskets of each span.
SPANS = [(0, 0, 0.001, 1000), (1000, 1, 1, 60), (1060, 60, 60, 60), (1120, 3600, 3600, 24), (1144, 86_400, 86_400, 365)]
LONG_BASKET, LONG_FROM = 1509, 31_536_000


def time_basket(seconds: Column) -> Column:
    """Basket 0 to 1509 of a time difference: milliseconds, seconds, minutes, hours, days, beyond a year."""
    t = seconds.cast("double")
    out = F.lit(LONG_BASKET)
    for k in reversed(range(len(SPANS))):
        start, first, width, n = SPANS[k]
        past = SPANS[k + 1][1] if k + 1 < len(SPANS) else LONG_FROM
        # multiplied, not divided, below a second: 0.15 s is 150 ms
        steps = (t * 1000 if k == 0 else (t - first) / width).cast("bigint")
        out = F.when(t < past, F.lit(start) + F.least(F.greatest(steps, F.lit(0)), F.lit(n - 1))).otherwise(out)
    return out.cast("int")


def basket_label(basket: Column) -> Column:
    unit = ["ms", "s", "min", "hr", "day"]
    out = F.lit("365+days")
    for k in reversed(range(len(SPANS))):
        start = SPANS[k][0]
        past = SPANS[k + 1][0] if k + 1 < len(SPANS) else LONG_BASKET
        out = F.when(basket < past, F.concat((basket - start + (0 if k == 0 else 1)).cast("string"), F.lit(unit[k]))).otherwise(out)
    return out
