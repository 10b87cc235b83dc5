"""Account onboarding: accepted accounts, request status, dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.functions.rules import is_accepted_brand, is_other_brand, request_label
from cardflow.operators.decode import dead_letters, decode_accounts, valid
from cardflow.operators.keyed import latest_per_key, stored_branches, with_branch

_ACCOUNT_COLUMNS = ["account_name", "account_last_update", "user_document_id",
                    "credit_card_number", "security_code", "expiration_date", "brand_name"]


@dataclass(frozen=True)
class Onboarding:
    accounts: DataFrame
    requests: DataFrame
    dead_letters: DataFrame
    counts: dict[str, int]  # requests by outcome: accepted, other, dead


def branch_accounts(decoded: DataFrame) -> DataFrame:
    """Valid accounts with branch 0 (accepted brand) or 1 (any other, also none)."""
    brand = F.col("brand_name")
    return with_branch(valid(decoded), is_accepted_brand(brand), is_other_brand(brand))


def accepted_accounts(decoded: DataFrame) -> DataFrame:
    return branch_accounts(decoded).filter("branch = 0").drop("branch")


def rejected_accounts(decoded: DataFrame) -> DataFrame:
    return branch_accounts(decoded).filter("branch = 1").drop("branch")


def accounts_state(decoded: DataFrame) -> DataFrame:
    """Latest account per account id; one topic's offset is the order."""
    return _latest_accounts(accepted_accounts(decoded))


def _latest_accounts(accepted: DataFrame) -> DataFrame:
    return latest_per_key(accepted, "account_id", _ACCOUNT_COLUMNS, F.struct("partition", "offset"))


def request_status(decoded: DataFrame) -> DataFrame:
    """Latest status text per request key.

    Both branches are labelled in one pass; only the new account id (null for a
    refusal) goes through the aggregate and the text is made afterwards.
    """
    return _latest_status(branch_accounts(decoded))


def _latest_status(branched: DataFrame) -> DataFrame:
    marked = branched.select(
        "key",
        F.when(F.col("branch") == 0, F.col("account_id")).alias("accepted_id"),
        F.struct("partition", "offset").alias("seq"),
    )
    latest = latest_per_key(marked, "key", ["accepted_id"], F.col("seq"))
    accepted = F.col("accepted_id").isNotNull()
    return latest.select("key", request_label(F.col("accepted_id"), accepted).alias("value"))


def onboarding(raw: DataFrame) -> Onboarding:
    """All three results; requests are decoded once and stored by outcome."""
    ok, brand = F.col("is_valid"), F.col("brand_name")
    parts = stored_branches(decode_accounts(raw), accepted=ok & is_accepted_brand(brand),
                            other=ok & is_other_brand(brand), dead=~ok)
    return Onboarding(
        _latest_accounts(parts.of("accepted")), _latest_status(parts.of("accepted", "other")),
        dead_letters(parts.of("dead")), parts.counts,
    )
