"""DuckDB SQL with the expected result of every query, over the same tables.

Written from the rules of the flow, not from the Spark plans: expected fields of
a request text come from the table columns, and the ledger is a recursive query.
"""

from __future__ import annotations

from cardflow.sources import fixtures as fx

_NIGHT = "(epoch_ms(order_date) % 86400000 > 0 AND epoch_ms(order_date) % 86400000 < 14400000)"
_ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%g+00:00')"


def _fixture(sql: str) -> str:
    return sql.replace("{iso}", _ISO.format(t="ts")).replace("{ms}", "CAST(epoch_ms(ts) AS VARCHAR)")


def _uuid(text: str) -> str:
    h = f"sha256({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts)


def _order_json(date: str, status: str = "payment_status", limit: str = "'null'") -> str:
    return f"""'{{"orderId":"' || order_id || '","accountId":"' || account_id
      || '","creditCardNumber":' || credit_card_number || ',"orderAmount":'
      || CAST(CAST(order_amount AS DECIMAL(38,6)) AS VARCHAR) || ',"paymentStatus":"'
      || {status} || '","orderDate":' || {date} || ',"creditLimit":' || {limit} || '}}'"""


_MILLIS = "CAST(epoch_ms(order_date) AS VARCHAR)"

# Common views; times of order dates are cut to milliseconds, event times are not.
_VIEWS = {
    "o": f"SELECT * REPLACE (date_trunc('milliseconds', order_date) AS order_date), "
         f"order_date AS event_ts FROM ({fx.ORDERS_SQL})",
    "t": f"SELECT *, order_date AS event_ts FROM ({fx.TOPUPS_SQL})",
    "clean": f"SELECT * FROM o WHERE NOT {_NIGHT}",
    "areq": _fixture(fx.ACCOUNT_REQUESTS_SQL),
    "acc": f"""
        SELECT 'req-' || c_custkey AS key, c_custkey AS seq, c_name AS account_name,
               4000000000000000 + c_custkey AS credit_card_number,
               CASE WHEN c_custkey % 23 = 0 THEN NULL
                    WHEN c_mktsegment = 'BUILDING' THEN 'NetCard'
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'NETCARD'
                    ELSE c_mktsegment END AS brand_name,
               {_uuid("'accounts-input:0:' || c_custkey || ':account'")} AS account_id,
               make_timestamp(CAST(c_custkey AS BIGINT) * 1000000) AS account_last_update
        FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0""",
    "oreq": _fixture(fx.ORDER_REQUESTS_SQL),
    "ord": f"""
        SELECT event_id AS seq, ts AS event_ts,
               {_uuid("'orders-input:0:' || event_id")} AS order_id,
               CASE WHEN event_id % 37 <> 0 AND event_id % 41 = 0 THEN NULL
                    ELSE CAST(user_id AS VARCHAR) END AS account_id,
               CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 OR event_id % 43 = 0 THEN NULL
                    ELSE 4000000000000000 + user_id END AS credit_card_number,
               CASE WHEN event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 43 = 0 THEN NULL
                    ELSE CAST(value AS DECIMAL(18,2)) END AS order_amount,
               CASE WHEN event_id % 37 = 0 THEN NULL
                    ELSE date_trunc('milliseconds', ts) END AS order_date,
               CASE WHEN event_id % 37 = 0 THEN 5.5 END AS credit_limit
        FROM events
        WHERE event_type = 'purchase' AND event_id % 29 <> 0 AND event_id % 31 <> 0""",
    "breq": _fixture(fx.BALANCE_REQUESTS_SQL),
    "top": f"""
        SELECT event_id AS seq, ts AS event_ts, CAST(user_id AS VARCHAR) AS account_id,
               CASE WHEN event_id % 31 <> 0 THEN 4000000000000000 + user_id END
                 AS credit_card_number,
               CASE WHEN event_id % 31 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS order_amount,
               {_uuid("'balances-input:0:' || event_id || ':topup'")} AS order_id
        FROM events WHERE event_type = 'signup' AND event_id % 29 <> 0""",
}

_EVENT = ("order_id", "account_id", "credit_card_number", "order_amount", "event_ts")
_FEED = f"""
    SELECT {", ".join(_EVENT)}, CAST(NULL AS DECIMAL(18,2)) AS credit_limit,
           FALSE AS is_topup, 1 AS source_rank, event_seq FROM clean
    UNION ALL
    SELECT {", ".join(_EVENT)}, 1000.00, TRUE, 0, event_seq FROM t"""
_POOLED_FEED = f"""
    SELECT * REPLACE (CASE WHEN CAST(account_id AS BIGINT) % 3 = 0 THEN 'pooled'
                           ELSE account_id END AS account_id) FROM ({_FEED})"""
_GRID_FEED = f"""
    SELECT * REPLACE (CAST(CASE WHEN is_topup THEN CASE WHEN event_seq % 97 = 0 THEN 70 ELSE 50 END
                                ELSE ceil(order_amount / 100) * 100 END AS DECIMAL(18,2)) AS order_amount)
    FROM ({_POOLED_FEED})"""
_TOPIC_FEED = f"""
    SELECT {", ".join(_EVENT)}, CAST(NULL AS DECIMAL(18,2)) AS credit_limit,
           FALSE AS is_topup, 1 AS source_rank, event_seq FROM clean
    UNION ALL
    SELECT {", ".join(_EVENT)}, 1000.00, TRUE, 0, seq FROM top WHERE order_amount IS NOT NULL"""
_RAW_FEED = f"""
    SELECT {", ".join(_EVENT)}, CAST(NULL AS DECIMAL(18,2)) AS credit_limit,
           FALSE AS is_topup, 1 AS source_rank, seq AS event_seq FROM ord
    WHERE order_date IS NOT NULL AND account_id IS NOT NULL AND order_amount IS NOT NULL
      AND NOT {_NIGHT}
    UNION ALL
    SELECT {", ".join(_EVENT)}, 1000.00, TRUE, 0, seq FROM top WHERE order_amount IS NOT NULL"""


def _with(body: str, *views: str, feed: str | None = None) -> str:
    """The body after the views it needs and, given a feed, the ledger ``led``."""
    parts = [f"{v} AS ({_VIEWS[v]})" for v in _VIEWS if v in views]
    if feed is not None:
        parts += [
            f"feed AS ({feed})",
            """seqd AS (SELECT *, row_number() OVER (
                 PARTITION BY account_id ORDER BY event_ts, source_rank, event_seq) AS rn
               FROM feed)""",
            """led AS (
               SELECT *, CAST(CASE WHEN is_topup THEN order_amount
                                   WHEN 0 >= order_amount THEN -order_amount ELSE 0 END
                              AS DECIMAL(38,2)) AS balance,
                      is_topup OR 0 >= order_amount AS accepted
               FROM seqd WHERE rn = 1
               UNION ALL
               SELECT s.*, CAST(CASE WHEN s.is_topup THEN l.balance + s.order_amount
                                     WHEN l.balance >= s.order_amount
                                       THEN l.balance - s.order_amount
                                     ELSE l.balance END AS DECIMAL(38,2)),
                      s.is_topup OR l.balance >= s.order_amount
               FROM led l JOIN seqd s ON s.account_id = l.account_id AND s.rn = l.rn + 1)""",
            "res AS (SELECT *, CASE WHEN accepted THEN 'EXECUTED' ELSE 'NOT_EXECUTED' END AS status"
            " FROM led)",
        ]
    recursive = "RECURSIVE " if feed is not None else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body


_VALUE = "CAST(order_amount AS DECIMAL(38,6))::VARCHAR AS order_amount"
_BALANCES = """
    SELECT account_id, credit_card_number, CAST(balance AS DECIMAL(38,6))::VARCHAR AS balance,
           CAST(credit_limit AS DECIMAL(38,6))::VARCHAR AS credit_limit, order_id, status AS payment_status
    FROM res QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY rn DESC) = 1"""
_LIFECYCLE = f"""
    SELECT o.order_id, o.account_id, o.credit_card_number,
           CAST(o.order_amount AS DECIMAL(38,6))::VARCHAR AS order_amount,
           CASE WHEN r.status IS NULL THEN 'CREATED' ELSE 'COMPLETED-' || r.status END
             AS payment_status, o.order_date, CAST(NULL AS VARCHAR) AS credit_limit
    FROM o LEFT JOIN res r ON r.order_id = o.order_id AND NOT r.is_topup
    UNION ALL
    SELECT order_id, account_id, credit_card_number, CAST(balance AS DECIMAL(38,6))::VARCHAR,
           'COMPLETED-' || status, {{date}}, NULL FROM res WHERE is_topup"""

_LABEL = """CASE WHEN lower(coalesce(brand_name, '')) = 'netcard'
                 THEN 'Account id: ' || account_id ELSE 'Invalid Request' END"""
_ACCEPTED = "lower(coalesce(brand_name, '')) = 'netcard'"
_DLQ = """
    SELECT key, value, 'accounts-input' AS topic,
           CASE WHEN seq % 17 = 0 THEN 'malformed_json' ELSE 'unknown_property' END AS reason
    FROM areq WHERE seq % 17 = 0 OR seq % 19 = 0"""


def _messages(extra: str) -> str:
    return f"""
    SELECT 'account-' || c_custkey AS key,
           '{{"accountId":"' || c_custkey || '","accountName":"' || c_name
             || '","messageContent":"' || c_mktsegment || '"}}' AS value{extra} FROM customer"""


_ORDER_STATE = """
    WITH e AS (SELECT * REPLACE (date_trunc('milliseconds', order_date) AS order_date)
               FROM (%s)),
         d AS (SELECT order_id, min(event_seq) FILTER (order_date IS NOT NULL) AS first_dated
               FROM e GROUP BY order_id)
    SELECT e.order_id,
           arg_min(account_id, event_seq) FILTER (account_id IS NOT NULL) AS account_id,
           arg_min(credit_card_number, event_seq) FILTER (credit_card_number IS NOT NULL)
             AS credit_card_number,
           CAST(arg_min(order_amount, event_seq) FILTER (order_amount IS NOT NULL) AS DECIMAL(38,6))::VARCHAR
             AS order_amount,
           CASE arg_max_null(payment_status, event_seq)
             WHEN 'NOT_FRAUD' THEN 'PROGRESS' WHEN 'EXECUTED' THEN 'COMPLETED-EXECUTED'
             WHEN 'NOT_EXECUTED' THEN 'COMPLETED-NOT_EXECUTED'
             ELSE arg_max_null(payment_status, event_seq) END AS payment_status,
           arg_min(order_date, event_seq) FILTER (order_date IS NOT NULL) AS order_date,
           CAST(arg_max(credit_limit, event_seq)
                FILTER (first_dated IS NULL OR event_seq < first_dated) AS DECIMAL(38,6))::VARCHAR AS credit_limit
    FROM e JOIN d ON d.order_id = e.order_id GROUP BY e.order_id""" % fx.ORDER_EVENTS_SQL


def all_oracles() -> dict[str, str]:
    lifecycle = _with(_LIFECYCLE.format(date="event_ts"), "o", "t", "clean", feed=_FEED)
    flow = _with(
        _LIFECYCLE.format(date="date_trunc('milliseconds', event_ts)"), "o", "t", "clean",
        feed=_FEED,
    )
    balances = _with(_BALANCES, "o", "t", "clean", feed=_FEED)
    status = _with(f"SELECT key, {_LABEL} AS value FROM acc", "acc")
    verdict = f"CASE WHEN {_NIGHT} THEN 'FRAUD' ELSE 'NOT_FRAUD' END"
    report = f"'Authorities warned ' || {_order_json(_MILLIS)}"
    changes = """SELECT account_id, order_id, CAST(order_amount AS DECIMAL(38,6))::VARCHAR AS event_amount,
                        is_topup, CAST(balance AS DECIMAL(38,6))::VARCHAR AS balance, status AS payment_status
                 FROM res"""
    verdicts = _with(f"SELECT order_id AS key, {verdict} AS value FROM o", "o")
    raw = _with(
        f"""SELECT o.order_id, o.account_id, o.credit_card_number,
                   CAST(o.order_amount AS DECIMAL(38,6))::VARCHAR AS order_amount,
                   CASE WHEN r.status IS NOT NULL THEN 'COMPLETED-' || r.status
                        WHEN o.order_date IS NULL OR {_NIGHT} THEN 'CREATED'
                        ELSE 'PROGRESS' END AS payment_status,
                   o.order_date,
                   CAST(CASE WHEN o.order_date IS NULL THEN o.credit_limit END AS DECIMAL(38,6))::VARCHAR
                     AS credit_limit
            FROM (SELECT * FROM ord) o
            LEFT JOIN (SELECT order_id, status FROM res WHERE NOT is_topup) r
              ON r.order_id = o.order_id
            UNION ALL
            SELECT order_id, account_id, credit_card_number, CAST(balance AS DECIMAL(38,6))::VARCHAR,
                   'COMPLETED-' || status, event_ts, NULL FROM res WHERE is_topup""",
        "ord", "top", feed=_RAW_FEED)
    return {
        "scan_raw_events": """
            SELECT CAST(user_id AS VARCHAR) AS key, props AS value, 'events' AS topic,
                   0 AS partition, event_id AS "offset", ts AS "timestamp" FROM events""",
        "topic_range_scan": """
            SELECT event_id, user_id, ts, log_offset
            FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS log_offset, count(*) OVER () AS n FROM events)
            WHERE log_offset >= n // 4 AND log_offset < 3 * n // 4""",
        "publish_order_json": _with(
            "SELECT order_id AS key, "
            + _order_json("'\"' || " + _ISO.format(t="order_date") + " || '\"'")
            + " AS value FROM o", "o"),
        "accounts_dlq": _with(_DLQ, "areq"),
        "account_messages_dlq": _messages(
            ", 'accounts-input' AS topic, 'unknown_property' AS reason"),
        "orders_output": _with(
            f"""SELECT order_id AS key, {_order_json(_MILLIS, "'PROGRESS'")} AS value
                FROM clean""", "o", "clean"),
        "frauds_output": _with(
            f"SELECT order_id AS key, {_order_json(_MILLIS)} AS value FROM o WHERE {_NIGHT}", "o"),
        "cleared_orders_feed": _with(
            f"""SELECT order_id AS key, {_order_json(_MILLIS, "'NOT_FRAUD'")} AS value
                FROM clean""", "o", "clean"),
        "ledger_results_feed": _with(
            f"""SELECT order_id AS key, {_order_json(_MILLIS, "status", "'0.000000'")} AS value
                FROM (SELECT order_id, account_id, credit_card_number, balance AS order_amount,
                             status, date_trunc('milliseconds', event_ts) AS order_date FROM res)""",
            "o", "t", "clean", feed=_FEED),
        "topic_round_trip": _with("SELECT key, value, seq AS \"offset\" FROM breq", "breq"),
        "fraud_report": _with(
            f"SELECT order_id AS key, {report} AS report FROM o WHERE {_NIGHT}", "o"),
        "decode_accounts": _with(
            """SELECT key, account_id, account_name, account_last_update,
                      credit_card_number, brand_name FROM acc""", "acc"),
        "decode_orders": _with(
            f"""SELECT seq AS "offset", account_id, credit_card_number, {_VALUE}, order_date,
                       CAST(credit_limit AS DECIMAL(38,6))::VARCHAR AS credit_limit FROM ord""", "ord"),
        "decode_account_details": """
            SELECT key, CASE WHEN ok THEN 'doc-' || n END AS user_document_id,
                   CASE WHEN ok THEN 4000000000000000 + n END AS credit_card_number,
                   CASE WHEN ok AND n % 3 <> 0 THEN CAST(n % 1000 AS VARCHAR) END
                     AS security_code,
                   CASE WHEN ok THEN TIMESTAMP '2030-01-01' END AS expiration_date,
                   ok AS is_valid, reason
            FROM (SELECT *, reason IS NULL AS ok FROM (
              SELECT 'req-' || c_custkey AS key, c_custkey AS n,
                     CASE WHEN c_custkey % 17 = 0 THEN 'bad_account_last_update'
                          WHEN c_custkey % 7 = 0 THEN 'bad_credit_card_number'
                          WHEN c_custkey % 11 = 0 THEN 'bad_security_code'
                          WHEN c_custkey % 13 = 0 THEN 'bad_expiration_date' END AS reason
              FROM customer))""",
        "decode_money_edges": """
            SELECT event_id AS "offset",
                   CAST(CASE event_id % 6
                     WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,6))
                     WHEN 2 THEN CAST(event_id || '0000000000000000000000' AS DECIMAL(38,6))
                     WHEN 3 THEN CAST((event_id // 1000) || '.' || lpad(CAST(event_id % 1000
                       AS VARCHAR), 3, '0') AS DECIMAL(38,6))
                     WHEN 4 THEN CAST(event_id * 100 + 50 AS DECIMAL(38,6)) END AS VARCHAR)
                     AS order_amount,
                   CASE WHEN event_id % 6 IN (1, 5) THEN 'bad_order_amount' END AS reason
            FROM events""",
        "decode_date_edges": """
            SELECT event_id AS "offset",
                   CAST(CASE event_id % 6
                     WHEN 0 THEN TIMESTAMP '2023-03-01' + to_days(CAST((event_id // 6) % 3 AS INTEGER))
                     WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                     WHEN 3 THEN TIMESTAMP '2024-05-01' + (date_trunc('second', ts) - date_trunc('day', ts))
                     WHEN 4 THEN NULL
                     ELSE date_trunc('second', ts) END AS TIMESTAMP) AS order_date,
                   CASE WHEN event_id % 6 = 4 THEN 'bad_order_date' END AS reason
            FROM events""",
        "created_orders": _with(
            f"""SELECT order_id, account_id, credit_card_number, {_VALUE},
                       payment_status, order_date, CAST(NULL AS VARCHAR) AS credit_limit
                FROM o""", "o"),
        "topup_orders": _with(
            f"""SELECT order_id, account_id, credit_card_number, {_VALUE},
                       'ADD_BALANCE' AS payment_status, event_ts AS order_date,
                       CAST(1000 AS DECIMAL(38,6))::VARCHAR AS credit_limit FROM top""", "top"),
        "decode_outcome_counts": _with(
            """SELECT topic, outcome, count(*) AS n FROM (
                 SELECT 'accounts-input' AS topic,
                        CASE WHEN seq % 17 = 0 THEN 'malformed_json'
                             WHEN seq % 19 = 0 THEN 'unknown_property' ELSE 'ok' END AS outcome
                 FROM areq
                 UNION ALL
                 SELECT 'orders-input',
                        CASE WHEN seq % 29 = 0 THEN 'malformed_json'
                             WHEN seq % 31 = 0 THEN 'unknown_property' ELSE 'ok' END FROM oreq
                 UNION ALL
                 SELECT 'balances-input',
                        CASE WHEN seq % 29 = 0 THEN 'malformed_json' ELSE 'ok' END FROM breq)
               GROUP BY topic, outcome""", "areq", "oreq", "breq"),
        "order_dead_letters": _with(
            """SELECT key, value, CASE WHEN seq % 29 = 0 THEN 'malformed_json'
                                       WHEN seq % 31 = 0 THEN 'unknown_property'
                                       ELSE 'null_order_date' END AS reason
               FROM oreq WHERE seq % 29 = 0 OR seq % 31 = 0 OR seq % 37 = 0""", "oreq"),
        "request_keys": _with(
            f"""SELECT 'accounts-input' AS topic, seq AS "offset",
                       {_uuid("'accounts-input:0:' || seq")} AS request_key FROM areq
                UNION ALL
                SELECT 'balances-input', seq, {_uuid("'balances-input:0:' || seq")} FROM breq""",
            "areq", "breq"),
        "order_intake": _with(
            f"""SELECT seq AS "offset", order_id, account_id, {_VALUE},
                       'CREATED' AS payment_status FROM ord""", "ord"),
        "prefixed_account_key": _messages(""),
        "request_status": status,
        "fraud_verdicts": verdicts,
        "stream_fraud_verdicts": verdicts,
        "stream_ledger_results": _with(changes, "o", "t", "clean", feed=_FEED),
        "stream_ledger_restarted": _with(changes, "o", "t", "clean", feed=_FEED),
        "live_balances": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS account_id, s.balance
            FROM customer LEFT JOIN ({balances}) s ON s.account_id = CAST(c_custkey AS VARCHAR)""",
        "live_orders": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS order_id, s.* EXCLUDE (order_id)
            FROM customer LEFT JOIN ({_ORDER_STATE}) s ON s.order_id = CAST(c_custkey AS VARCHAR)""",
        "stream_order_state": _ORDER_STATE,
        "cleared_orders": _with(
            f"""SELECT order_id, account_id, credit_card_number, {_VALUE},
                       'NOT_FRAUD' AS payment_status, order_date,
                       CAST(NULL AS VARCHAR) AS credit_limit FROM clean""", "o", "clean"),
        "orders_finished": _with(
            """SELECT order_id, account_id, CAST(balance AS DECIMAL(38,6))::VARCHAR AS order_amount,
                      'COMPLETED-' || status AS payment_status FROM res""",
            "o", "t", "clean", feed=_FEED),
        "accounts_netcard": _with(
            f"SELECT key, account_name, brand_name FROM acc WHERE {_ACCEPTED}", "acc"),
        "accounts_other_brand": _with(
            f"SELECT key, account_name, brand_name FROM acc WHERE NOT {_ACCEPTED}", "acc"),
        "branch_accounts": _with(
            f"SELECT key, CASE WHEN {_ACCEPTED} THEN 0 ELSE 1 END AS branch FROM acc", "acc"),
        "branch_orders": _with(
            f"SELECT order_id, CASE WHEN {_NIGHT} THEN 1 ELSE 0 END AS branch FROM o", "o"),
        "rekey_by_account": _with("SELECT account_id AS key, order_id FROM o", "o"),
        "events_per_key": """
            SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events
            WHERE user_id IS NOT NULL GROUP BY user_id""",
        "ledger_input_union": _with(
            f"""SELECT order_id, account_id, {_VALUE},
                       CASE WHEN is_topup THEN 'ADD_BALANCE' ELSE 'PROGRESS' END AS payment_status,
                       source_rank, event_ts, event_seq FROM ({_FEED})""", "o", "t", "clean"),
        "accounts_state": _with(
            f"""SELECT account_id, account_name, account_last_update, credit_card_number,
                       brand_name FROM acc WHERE {_ACCEPTED}""", "acc"),
        "order_state": _ORDER_STATE,
        "account_balances": balances,
        "ledger_results": _with(
            """SELECT order_id, account_id, credit_card_number,
                      CAST(balance AS DECIMAL(38,6))::VARCHAR AS order_amount, status AS payment_status,
                      CAST(0 AS DECIMAL(38,6))::VARCHAR AS credit_limit,
                      CAST(order_amount AS DECIMAL(38,6))::VARCHAR AS event_amount, is_topup FROM res""",
            "o", "t", "clean", feed=_FEED),
        "ledger_results_pooled": _with(changes, "o", "t", "clean", feed=_POOLED_FEED),
        "ledger_results_grid": _with(changes, "o", "t", "clean", feed=_GRID_FEED),
        "account_balances_pooled": _with(_BALANCES, "o", "t", "clean", feed=_POOLED_FEED),
        "lookup_accounts": _with(
            f"""SELECT a.account_id, s.account_name, s.brand_name
                FROM (SELECT {_uuid("'accounts-input:0:' || seq || ':account'")} AS account_id
                      FROM areq) a
                LEFT JOIN (SELECT * FROM acc WHERE {_ACCEPTED}) s USING (account_id)""",
            "areq", "acc"),
        "lookup_requests": _with(
            f"""SELECT a.key, s.value FROM areq a
                LEFT JOIN (SELECT key, {_LABEL} AS value FROM acc) s USING (key)""",
            "areq", "acc"),
        "lookup_orders": f"""
            SELECT CAST(e.event_id AS VARCHAR) AS order_id, s.account_id, s.payment_status
            FROM events e LEFT JOIN ({lifecycle}) s
              ON s.order_id = CAST(e.event_id AS VARCHAR)""",
        "lookup_balances": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS account_id, s.balance, s.payment_status
            FROM customer LEFT JOIN ({balances}) s ON s.account_id = CAST(c_custkey AS VARCHAR)""",
        "lookup_verdicts": _with(
            f"""SELECT CAST(e.event_id AS VARCHAR) AS key,
                       CASE WHEN o.order_id IS NOT NULL THEN {verdict} END AS value
                FROM events e LEFT JOIN o ON o.order_id = CAST(e.event_id AS VARCHAR)""", "o"),
        "lookup_bucketed": _with(
            f"""SELECT a.part, a.key, CASE WHEN o.order_id IS NOT NULL THEN {verdict} END AS value
                FROM (SELECT 'event' AS part, CAST(event_id AS VARCHAR) AS key FROM events
                      UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer) a
                LEFT JOIN o ON o.order_id = a.key""", "o"),
        "branch_counts": _with(
            f"""SELECT 'accounts' AS flow, 'accepted' AS branch, count(*) AS n FROM acc WHERE {_ACCEPTED}
                UNION ALL SELECT 'accounts', 'other', count(*) FROM acc WHERE ({_ACCEPTED}) IS NOT TRUE
                UNION ALL SELECT 'accounts', 'dead', count(*) FROM ({_DLQ})
                UNION ALL SELECT 'orders', 'clean', count(*) FROM clean
                UNION ALL SELECT 'orders', 'night', count(*) FROM o WHERE {_NIGHT}
                UNION ALL SELECT 'orders', 'undated', count(*) FROM o WHERE order_date IS NULL""",
            "acc", "areq", "o", "clean"),
        "account_onboarding": _with(
            f"""SELECT 'account' AS part, account_id AS key, account_name AS value
                FROM acc WHERE {_ACCEPTED}
                UNION ALL SELECT 'request', key, {_LABEL} FROM acc
                UNION ALL SELECT 'dead letter', key, value FROM ({_DLQ})""", "acc", "areq"),
        "fraud_screen": _with(
            f"""SELECT 'verdict' AS part, order_id AS key, {verdict} AS value FROM o
                UNION ALL SELECT 'cleared', order_id, 'NOT_FRAUD' FROM clean
                UNION ALL SELECT 'report', order_id, {report} FROM o WHERE {_NIGHT}""",
            "o", "clean"),
        "balance_ledger": _with(
            f"""SELECT account_id, credit_card_number, balance, credit_limit, order_id,
                       payment_status FROM ({_BALANCES})""", "o", "clean", "top", feed=_TOPIC_FEED),
        "balance_ledger_dead_letters": _with(
            """SELECT key, value, 'balances-input' AS topic,
                      CASE WHEN seq % 29 = 0 THEN 'malformed_json' ELSE 'null_amount' END AS reason
               FROM breq WHERE seq % 29 = 0 OR seq % 31 = 0""", "breq"),
        "order_flow": flow,
        "order_lifecycle": lifecycle,
        "order_lifecycle_raw": raw,
        "flow_orders": f"SELECT * EXCLUDE (order_date) FROM ({raw})",
        "flow_balances": _with(_BALANCES, "ord", "top", feed=_RAW_FEED),
    }
