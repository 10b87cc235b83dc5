"""Raw topic records to typed records; bad ones keep a reason instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.ids import record_uuid, uuid_of
from cardflow.functions.json_text import decode_json
from cardflow.functions.rules import has_status


def decode_accounts(raw: DataFrame) -> DataFrame:
    """Account requests; valid ones get a new account id and an update time."""
    stamped = decode_json(raw, S.ACCOUNT)
    return stamped.withColumns(
        {
            "account_id": F.when(F.col("is_valid"), record_uuid("account")),
            "account_last_update": F.when(
                F.col("is_valid"), F.col("timestamp").cast("timestamp_ntz")
            ),
        }
    )


def decode_orders(raw: DataFrame) -> DataFrame:
    return decode_json(raw, S.ORDER)


def created_orders(decoded: DataFrame) -> DataFrame:
    """Decodable orders in status CREATED, the only ones the fraud screen looks at."""
    return decoded.filter(F.col("is_valid") & has_status(F.col("payment_status"), S.CREATED))


def decode_topups(raw: DataFrame) -> DataFrame:
    """Balance requests as top-up orders.

    Amount is the requested balance; id, status, limit and date are set here,
    whatever the request says about them.
    """
    decoded = decode_json(raw, S.BALANCE)
    return decoded.select(
        *[c for c in raw.columns],
        record_uuid("topup").alias("order_id"),
        "account_id",
        "credit_card_number",
        F.col("balance").alias("order_amount"),
        F.lit(S.ADD_BALANCE).alias("payment_status"),
        F.col("timestamp").alias("order_date"),
        F.lit(S.TOPUP_CREDIT_LIMIT).cast(S.MONEY).alias("credit_limit"),
        "is_valid",
        "reason",
    )


def valid(decoded: DataFrame) -> DataFrame:
    return decoded.filter("is_valid").drop("is_valid", "reason")


def dead_letters(decoded: DataFrame) -> DataFrame:
    """The exact complement of ``valid``: raw text and key, plus the reason."""
    return decoded.filter(~F.col("is_valid")).select("key", "value", "topic", "reason")


def decode_outcomes(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


def request_key() -> Column:
    """Key of an incoming request, derived from where it arrived."""
    return uuid_of(
        F.concat_ws(":", F.col("topic"), F.col("partition").cast("string"),
                    F.col("offset").cast("string"))
    )


def order_intake(raw: DataFrame) -> DataFrame:
    """Order requests as accepted by the shop front: new id, status CREATED.

    Undecodable requests are kept with their reason and get no id.
    """
    decoded = decode_orders(raw)
    ok = F.col("is_valid")
    return decoded.withColumns(
        {
            "order_id": F.when(ok, request_key()),
            "payment_status": F.when(ok, F.lit(S.CREATED)),
        }
    )
