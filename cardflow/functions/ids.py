"""Deterministic identifiers: a recomputed row always gets the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflow.schemas import ACCOUNT_KEY_PREFIX


def uuid_of(text: Column) -> Column:
    """UUID-shaped id from the SHA-256 of a text."""
    groups = r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$"
    return F.regexp_replace(F.sha2(text, 256), groups, "$1-$2-$3-$4-$5")


def record_uuid(purpose: str) -> Column:
    """Id of the current topic record for one purpose (account, topup, ...)."""
    return uuid_of(
        F.concat_ws(
            ":",
            F.col("topic"),
            F.col("partition").cast("string"),
            F.col("offset").cast("string"),
            F.lit(purpose),
        )
    )


def prefixed_account_key(account_id: Column) -> Column:
    """Key of an account message; a null id prints as the text ``null``."""
    return F.concat(F.lit(ACCOUNT_KEY_PREFIX), F.coalesce(account_id, F.lit("null")))
