"""Strict decoding: one row per rule."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.operators import decode
from cardflow.plans import accounts
from cardflow.session import stored

T3 = datetime(2024, 1, 1, 3)


def raw(spark, values, topic="t"):
    rows = [("k%d" % i, v, topic, 0, i, datetime(2024, 5, 1)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, S.TOPIC_SCHEMA)


def decoded(spark, values, operator=decode.decode_orders):
    return operator(raw(spark, values)).orderBy("offset").collect()


CASES = {
    # text: (valid, reason or expected fields)
    '{"orderId":"a"}': {"order_id": "a", "order_amount": None},
    '{"orderId":5}': {"order_id": "5"},
    '{"orderId":true}': {"order_id": "true"},
    '{"orderId":""}': {"order_id": ""},
    '{"orderId":"{x"}': {"order_id": "{x"},
    '{"orderId":{"z":1}}': "bad_order_id",
    '{"orderId":[1]}': "bad_order_id",
    '{"creditCardNumber":"12"}': {"credit_card_number": 12},
    '{"creditCardNumber":12.7}': {"credit_card_number": 12},
    '{"creditCardNumber":-12.7}': {"credit_card_number": -12},
    '{"creditCardNumber":1e3}': {"credit_card_number": 1000},
    '{"creditCardNumber":"12.7"}': "bad_credit_card_number",
    '{"creditCardNumber":{"z":1}}': "bad_credit_card_number",
    '{"creditCardNumber":true}': "bad_credit_card_number",
    '{"creditCardNumber":99999999999999999999}': "bad_credit_card_number",
    '{"creditCardNumber":""}': {"credit_card_number": None},
    '{"creditCardNumber":null}': {"credit_card_number": None},
    '{"orderAmount":12.5}': {"order_amount": Decimal("12.500000")},
    '{"orderAmount":"12.5"}': {"order_amount": Decimal("12.500000")},
    '{"orderAmount":20000000000.000001}': {"order_amount": Decimal("20000000000.000001")},
    '{"orderAmount":123456789012345678901.123456}': {
        "order_amount": Decimal("123456789012345678901.123456")},
    '{"orderAmount":1.0000001}': "bad_order_amount",
    '{"orderAmount":1.0000000000000004}': "bad_order_amount",
    '{"orderAmount":"1.0000000000001"}': "bad_order_amount",
    '{"orderAmount":1000000000000000000000000000}': {"order_amount": Decimal(10**27)},
    '{"orderAmount":"12345678901234567890123456789012.123456"}': {
        "order_amount": Decimal("12345678901234567890123456789012.123456")},
    '{"orderAmount":-12345678901234567890123456789012.1234560000}': {
        "order_amount": Decimal("-12345678901234567890123456789012.123456")},
    '{"orderAmount":123456789012345678901234567890123}': "bad_order_amount",
    '{"orderAmount":0.00000100000000}': {"order_amount": Decimal("0.000001")},
    '{"orderAmount":1e-6}': {"order_amount": Decimal("0.000001")},
    '{"orderAmount":1.5E-6}': "bad_order_amount",
    '{"orderAmount":"12.5e3"}': {"order_amount": Decimal("12500")},
    '{"orderAmount":1e31}': {"order_amount": Decimal(10**31)},
    '{"orderAmount":1e32}': "bad_order_amount",
    '{"orderAmount":0e99}': {"order_amount": Decimal(0)},
    '{"orderAmount":1,"orderAmount":20000000000.000001}': {"order_amount": Decimal("20000000000.000001")},
    '{"orderAmount":"x"}': "bad_order_amount",
    '{"orderAmount":" "}': {"order_amount": None},
    '{"orderDate":"2024-01-01T03:00:00.000+00:00"}': {"order_date": T3},
    '{"orderDate":"2024-01-01T03:00:00Z"}': {"order_date": T3},
    '{"orderDate":"2024-01-01T00:00:00.000-0300"}': {"order_date": T3},
    '{"orderDate":"2024-01-01T03:00Z"}': {"order_date": T3},
    '{"orderDate":"2024-01-01T03:00:00"}': {"order_date": T3},
    '{"orderDate":"2024-01-01"}': {"order_date": datetime(2024, 1, 1)},
    '{"orderDate":1704078000000}': {"order_date": T3},
    '{"orderDate":"1704078000000"}': {"order_date": T3},
    '{"orderDate":2024}': {"order_date": datetime(1970, 1, 1, 0, 0, 2, 24000)},
    '{"orderDate":"2024-01-01T03:00:00.0009Z"}': {"order_date": T3},
    '{"orderDate":"2024-13-01"}': "bad_order_date",
    '{"orderDate":"2024-02-30"}': {"order_date": datetime(2024, 3, 1)},
    '{"orderDate":"2023-02-29T03:00Z"}': {"order_date": datetime(2023, 3, 1, 3)},
    '{"orderDate":"2024-04-31T23:00:00.500-0300"}': {"order_date": datetime(2024, 5, 2, 2, 0, 0, 500000)},
    '{"orderDate":"2024-02-32"}': "bad_order_date",
    '{"orderDate":"Mon, 01 Jan 2024 03:00:00 GMT"}': {"order_date": T3},
    '{"orderDate":"Fri, 1 Jan 2024 00:00:00 -0300"}': {"order_date": T3},
    '{"orderDate":"Mon, 01 Jan 2024 05:00:00 GMT+02:00"}': {"order_date": T3},
    '{"orderDate":"Mon, 30 Feb 2024 05:00:00 UTC"}': {"order_date": datetime(2024, 3, 1, 5)},
    '{"orderDate":"Mon, 01 Jan 2024 03:00:00"}': "bad_order_date",
    '{"orderDate":"Mo, 01 Jan 2024 03:00:00 GMT"}': "bad_order_date",
    '{"orderDate":"soon"}': "bad_order_date",
    '{"orderDate":99999999999999999}': "bad_order_date",
    '{"orderId":"a","orderId":"b"}': {"order_id": "b"},
    '{"orderId":"a"} trailing': {"order_id": "a"},
    '{"orderId":"a","x":1}': "unknown_property",
    '{"orderid":"a"}': "unknown_property",
    "{'orderId':'a'}": "malformed_json",
    '{"orderAmount":NaN}': "malformed_json",
    '{"orderId":"a"': "malformed_json",
    "{}": {"order_id": None, "order_amount": None},
    "bad": "malformed_json",
    "[]": "malformed_json",
    "": "malformed_json",
    "null": "null_document",
    None: "null_value",
}


def test_order_rules(spark):
    for (text, expected), row in zip(CASES.items(), decoded(spark, list(CASES))):
        if isinstance(expected, str):
            assert (row.is_valid, row.reason) == (False, expected), text
            assert row.order_id is None and row.order_date is None, text
        else:
            assert row.is_valid and row.reason is None, (text, row.reason)
            for name, value in expected.items():
                assert row[name] == value, text


def test_account_rules(spark):
    cases = {
        '{"accountLastUpdate":"2024-01-01T10:00:00"}': True,
        '{"accountLastUpdate":[2024,1,1,10,0]}': True,
        '{"accountLastUpdate":"yesterday"}': False,
        '{"securityCode":7}': True,
        '{"securityCode":"7.5"}': True,
        '{"securityCode":"abc"}': False,
        '{"expirationDate":"2030-01-01"}': True,
    }
    got = decoded(spark, list(cases), decode.decode_accounts)
    assert [r.is_valid for r in got] == list(cases.values())
    assert len({r.account_id for r in got if r.is_valid}) == sum(cases.values())
    assert all(r.account_last_update == datetime(2024, 5, 1) for r in got if r.is_valid)


def test_brand_and_request_status(spark):
    values = ['{"brandName":"netcard"}', '{"brandName":"NETCARD"}', '{"brandName":"Visa"}',
              '{"brandName":null}', '{"x":1}', "bad", "[]", "null", None]
    done = accounts.onboarding(raw(spark, values))
    status = {r.key: r.value for r in done.requests.collect()}
    assert status["k0"].startswith("Account id: ") and status["k1"].startswith("Account id: ")
    assert status["k2"] == status["k3"] == "Invalid Request"
    assert set(status) == {"k0", "k1", "k2", "k3"}
    assert {r.key for r in done.dead_letters.collect()} == {"k4", "k5", "k6", "k7", "k8"}
    assert done.accounts.count() == 2


def test_latest_request_wins(spark):
    df = raw(spark, ['{"brandName":"Visa"}', '{"brandName":"NetCard"}']).withColumn("key", F.lit("r"))
    (row,) = accounts.onboarding(df).requests.collect()
    assert row.value.startswith("Account id: ")


def test_created_only_and_null_status(spark):
    values = ['{"paymentStatus":"CREATED"}', '{"paymentStatus":"NOT_FRAUD"}', "{}", "bad"]
    kept = decode.created_orders(decode.decode_orders(raw(spark, values))).collect()
    assert [r.key for r in kept] == ["k0"]


def test_topup_request(spark):
    text = '{"accountId":"a","creditCardNumber":4,"balance":2.5,"orderId":"mine","creditLimit":9}'
    row, bad = decoded(spark, [text, "[1]"], decode.decode_topups)
    assert (row.account_id, row.credit_card_number, row.order_amount) == ("a", 4, Decimal("2.5"))
    assert row.payment_status == "ADD_BALANCE" and row.credit_limit == Decimal("1000")
    assert row.order_id not in (None, "mine")
    assert not bad.is_valid


@pytest.mark.parametrize("millis", [False, True])
def test_encode_decode_round_trip(spark, millis):
    text = ('{"orderId":"o","accountId":null,"creditCardNumber":1,"orderAmount":1.25,'
            '"paymentStatus":"CREATED","orderDate":"2024-01-01T03:00:00.000+00:00",'
            '"creditLimit":null}')
    one = decode.decode_orders(raw(spark, [text]))
    again = one.withColumn("value", encode_json(S.ORDER, epoch_millis=millis))
    (encoded,) = again.select("value").collect()
    date = "1704078000000" if millis else '"2024-01-01T03:00:00.000+00:00"'
    assert encoded.value == (
        '{"orderId":"o","accountId":null,"creditCardNumber":1,"orderAmount":1.250000,'
        f'"paymentStatus":"CREATED","orderDate":{date},"creditLimit":null}}')
    fields = [f.column for f in S.ORDER]
    back = decode.decode_orders(again.select(*S.TOPIC_SCHEMA.fieldNames()))
    assert back.select(fields).collect() == one.select(fields).collect()


def test_stored_frame_reads_back(spark):
    df = decode.decode_orders(raw(spark, ['{"orderId":"a","orderAmount":1.5}', "bad"]))
    again = stored(df)
    assert "explode" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(again.collect(), key=repr) == sorted(df.collect(), key=repr)
