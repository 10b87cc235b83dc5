"""Predicates and labels of the flow, all null-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow import schemas as S


def is_night(instant: Column) -> Column:
    """Strictly between 00:00 and 04:00 UTC: such orders count as fraud.

    Independent of the session time zone.  Counting from one millisecond past
    midnight turns the open interval into one comparison.
    """
    past_start = F.unix_millis(instant) - F.lit(S.NIGHT_START_MS + 1)
    return F.pmod(past_start, F.lit(S.DAY_MS)) < S.NIGHT_END_MS - S.NIGHT_START_MS - 1


def is_accepted_brand(brand: Column) -> Column:
    return F.lower(brand).eqNullSafe(F.lit(S.ACCEPTED_BRAND.lower()))


def is_other_brand(brand: Column) -> Column:
    return ~is_accepted_brand(brand)


def has_status(status: Column, *wanted: str) -> Column:
    """True only for the given statuses; null counts as none of them."""
    return F.coalesce(status.isin(*wanted), F.lit(False))


def verdict(is_fraud: Column) -> Column:
    return F.when(is_fraud, S.FRAUD).otherwise(S.NOT_FRAUD)


def request_label(account_id: Column, accepted: Column) -> Column:
    return F.when(accepted, F.concat(F.lit(S.ACCOUNT_LABEL), account_id)).otherwise(
        S.REJECTED_LABEL
    )


def completed(status: Column) -> Column:
    return F.concat(F.lit(S.COMPLETED_PREFIX), status)


def stored_status(status: Column) -> Column:
    """Status as the order table keeps it: moved one step on when it is acted upon."""
    return (
        F.when(has_status(status, S.NOT_FRAUD), S.PROGRESS)
        .when(has_status(status, S.EXECUTED, S.NOT_EXECUTED), completed(status))
        .otherwise(status)
    )


def fraud_report(message: Column) -> Column:
    return F.concat(F.lit(S.REPORT_LABEL), message)
