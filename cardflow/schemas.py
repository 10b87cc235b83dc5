"""Record layouts, topic names and fixed texts of the payment flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: topics, statuses and labels that other systems read -----
ACCOUNTS_INPUT = "accounts-input"
ACCOUNTS_DLQ = "accounts-dlq"
ORDERS_INPUT = "orders-input"
ORDERS_OUTPUT = "orders-output"
BALANCES_INPUT = "balances-input"
FRAUDS_OUTPUT = "frauds-output"

CREATED = "CREATED"
NOT_FRAUD = "NOT_FRAUD"
FRAUD = "FRAUD"
PROGRESS = "PROGRESS"
ADD_BALANCE = "ADD_BALANCE"
EXECUTED = "EXECUTED"
NOT_EXECUTED = "NOT_EXECUTED"
COMPLETED_PREFIX = "COMPLETED-"

ACCEPTED_BRAND = "NetCard"
ACCOUNT_LABEL = "Account id: "
REJECTED_LABEL = "Invalid Request"
REPORT_LABEL = "Authorities warned "
ACCOUNT_KEY_PREFIX = "account-"
TOPUP_CREDIT_LIMIT = "1000.00"

# Night window in milliseconds after UTC midnight, both ends excluded.
NIGHT_START_MS = 0
NIGHT_END_MS = 4 * 60 * 60 * 1000
DAY_MS = 24 * 60 * 60 * 1000
# ---------------------------------------------------------------------------

# All money is decimal(38,6): the type survives addition and overflow is an error.
MONEY = T.DecimalType(38, 6)


@dataclass(frozen=True)
class Field:
    """One JSON property: its name in the text, its column, and how it is read."""

    json: str
    column: str
    kind: str  # text | long | money | instant | local_datetime | number


ACCOUNT = (
    Field("accountId", "account_id", "text"),
    Field("accountName", "account_name", "text"),
    Field("accountLastUpdate", "account_last_update", "local_datetime"),
    Field("userDocumentId", "user_document_id", "text"),
    Field("creditCardNumber", "credit_card_number", "long"),
    Field("securityCode", "security_code", "number"),
    Field("expirationDate", "expiration_date", "instant"),
    Field("brandName", "brand_name", "text"),
)

ORDER = (
    Field("orderId", "order_id", "text"),
    Field("accountId", "account_id", "text"),
    Field("creditCardNumber", "credit_card_number", "long"),
    Field("orderAmount", "order_amount", "money"),
    Field("paymentStatus", "payment_status", "text"),
    Field("orderDate", "order_date", "instant"),
    Field("creditLimit", "credit_limit", "money"),
)

BALANCE = (
    Field("accountId", "account_id", "text"),
    Field("creditCardNumber", "credit_card_number", "long"),
    Field("balance", "balance", "money"),
    Field("creditLimit", "credit_limit", "money"),
    Field("orderId", "order_id", "text"),
    Field("paymentStatus", "payment_status", "text"),
)

ACCOUNT_MESSAGE = (
    Field("accountId", "account_id", "text"),
    Field("accountName", "account_name", "text"),
    Field("messageContent", "message_content", "text"),
)

KIND_TYPES = {
    "text": T.StringType(),
    "long": T.LongType(),
    "money": MONEY,
    "instant": T.TimestampType(),
    "local_datetime": T.TimestampNTZType(),
    "number": T.StringType(),
}


def struct_of(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.column, KIND_TYPES[f.kind]) for f in fields])


ACCOUNT_SCHEMA = struct_of(ACCOUNT)
ORDER_SCHEMA = struct_of(ORDER)
BALANCE_SCHEMA = struct_of(BALANCE)
ACCOUNT_MESSAGE_SCHEMA = struct_of(ACCOUNT_MESSAGE)

# Shape of a topic record, the same for Kafka and for file-backed topics.
TOPIC_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
