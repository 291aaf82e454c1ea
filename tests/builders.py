"""Rows of the star for tests, and small readers of results."""

import datetime as dt
from decimal import Decimal


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def customer(session, person=None, state="S1"):
    return (session, person or session, "0", "city", state)


def order(order_id, session, purchased, status="delivered", delivered=None, estimated=None):
    return (order_id, session, ts(purchased), status, ts(delivered), ts(estimated))


def payment(order_id, value, kind="credit_card", installments=1, sequence=1):
    return (order_id, sequence, kind, installments, None if value is None else Decimal(str(value)))


def item(order_id, price, product="p1", seller="s1", number=1):
    return (order_id, number, product, seller, Decimal(str(price)), Decimal("1.00"))


def review(review_id, order_id, score):
    return (review_id, order_id, score)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
