"""The twelve analytical reports as named SQL statements with parameters, over the tables of a star.

A statement names its tables in braces and its parameters with colons; ``run`` fills both in and hands the text to
``run_query``. Rows are summed to the join key before they meet, as in the operators. Where a report needs order statistics
of all persons, these are parameters (or a scored table) that nested histograms found before, so that no statement sorts
all rows in one task.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopgauge.functions.columns import epoch_micros
from shopgauge.functions.selection import at_ranks
from shopgauge.operators.customers import global_scores, tile_ends
from shopgauge.operators.facts import sales_by_person
from shopgauge.session import materialize
from shopgauge.sources.tables import run_query
from shopgauge.star import Star


def _cents(amount: str) -> str:
    return f"cast(round({amount} * 100) as bigint)"


def _nearest(part: str, whole: str) -> str:
    """Whole part of a quotient to the nearest, halves away from zero; null over zero."""
    return f"(sign({part}) * ((2 * abs({part}) + ({whole})) div nullif(2 * ({whole}), 0)))"


def _mean(total: str, count: str) -> str:
    return f"{_nearest(total, count)} / 100.0D"


def _percent(part: str, whole: str) -> str:
    return f"{_nearest(f'({part}) * 10000', whole)} / 100.0D"


_PAID = f"""
payments as (select order_id, sum({_cents('payment_value')}) as cents, count(payment_value) as amounts from {{order_payments}} group by order_id),
paid as (select order_id, customer_id, order_purchase_timestamp, cents, amounts
         from {{orders}} join payments using (order_id) where order_status = :status)"""
_MONTHS = """
sessions as (select distinct customer_id, cast(date_trunc('MONTH', order_purchase_timestamp) as date) as month from {orders} where order_status = :status),
active as (select distinct customer_unique_id, month from sessions join {customers} using (customer_id) where customer_unique_id is not null)"""
_ITEMS = f"""
sold as (select order_id, coalesce(product_category_name_english, product_category_name) as category, count(*) as items,
                count(price) as prices, sum({_cents('price')}) as cents, sum(order_item_id) as numbers
         from {{order_items}} join {{products}} using (product_id) left join {{category_translation}} using (product_category_name)
         group by order_id, category),
reviewed as (select order_id, count(*) as reviews, count(review_score) as scores, sum(review_score) as total,
                    count_if(review_score >= 4) as good, count_if(review_score <= 2) as bad
             from {{order_reviews}} group by order_id)"""

STATEMENTS: dict[str, str] = {
    "revenue_by_state": f"""with {_PAID}
select customer_state as state, count(*) as total_orders, sum(cents) / 100.0D as total_revenue, {_mean('sum(cents)', 'sum(amounts)')} as avg_order_value
from paid join {{customers}} using (customer_id) group by customer_state order by total_revenue desc, state limit :top""",
    "monthly_revenue_growth": f"""with {_PAID},
monthly as (select cast(date_trunc('MONTH', order_purchase_timestamp) as date) as month, sum(cents) as cents from paid group by 1),
beside as (select *, lag(cents) over (order by month) as previous from monthly)
select month, cents / 100.0D as revenue, previous / 100.0D as prev_month_revenue, {_percent('cents - previous', 'previous')} as growth_pct
from beside order by month""",
    "cohort_retention_counts": f"""with {_MONTHS},
first as (select customer_unique_id, min(month) as cohort_month from active group by customer_unique_id)
select cohort_month, cast(12 * (year(month) - year(cohort_month)) + month(month) - month(cohort_month) as bigint) as month_offset, count(*) as active_customers
from active join first using (customer_unique_id) group by 1, 2 order by 1, 2""",
    "repeat_purchase_rate": f"""with
sessions as (select customer_id, count(order_id) as orders from {{orders}} where order_status = :status group by customer_id),
people as (select customer_unique_id, sum(orders) as orders from sessions join {{customers}} using (customer_id) group by customer_unique_id)
select count(*) as total_customers, count_if(orders > 1) as repeat_customers, {_percent('count_if(orders > 1)', 'count(*)')} as repeat_purchase_rate_pct
from people""",
    "top_sellers": f"""with
by_order as (select seller_id, order_id, sum({_cents('price')}) as cents, count(price) as prices from {{order_items}} group by seller_id, order_id),
revenue as (select seller_id, count(*) as orders_fulfilled, sum(cents) as cents, sum(prices) as prices from by_order group by seller_id)
select seller_id, seller_city, seller_state, orders_fulfilled, cents / 100.0D as total_revenue, {_mean('cents', 'prices')} as avg_item_price
from revenue join {{sellers}} using (seller_id) order by total_revenue desc, seller_id limit :top""",
    "monthly_retention": f"""with {_MONTHS},
again as (select customer_unique_id, cast(add_months(month, -1) as date) as month, true as returned from active)
select month as active_month, count(*) as active_count, count(returned) as retained_count, {_percent('count(returned)', 'count(*)')} as retention_rate_pct
from active left join again using (customer_unique_id, month) group by month order by month""",
    "category_performance": f"""with {_ITEMS}
select category, count(*) as total_orders, sum(numbers * coalesce(reviews, 1)) as total_items_sold, sum(cents * coalesce(reviews, 1)) / 100.0D as total_revenue,
       {_mean('sum(cents * coalesce(reviews, 1))', 'sum(prices * coalesce(reviews, 1))')} as avg_price,
       {_mean('sum(total * items) * 100', 'sum(scores * items)')} as avg_review_score
from sold left join reviewed using (order_id) group by category order by total_revenue desc, category limit :top_categories""",
    "delivery_performance": f"""with
took as (select customer_id, count(*) as orders,
                count_if(not coalesce(order_delivered_customer_date <= order_estimated_delivery_date, false)) as late,
                sum(cast(timestampdiff(MICROSECOND, order_purchase_timestamp, order_delivered_customer_date) as decimal(38, 0))) as micros
         from {{orders}} where order_status = :status and order_delivered_customer_date is not null group by customer_id),
by_state as (select customer_state, sum(orders) as orders, sum(late) as late, sum(micros) as micros
             from took join {{customers}} using (customer_id) group by customer_state)
select customer_state, orders as total_orders, late as late_orders, {_percent('late', 'orders')} as late_pct,
       {_nearest('micros', 'orders * 8640000000')} / 10.0D as avg_delivery_days
from by_state order by late_pct desc, customer_state""",
    "rfm_segments": """select customer_unique_id, r_score, f_score, m_score, r_score + f_score + m_score as rfm_total,
       case when r_score >= 4 and f_score >= 4 and m_score >= 4 then 'Champions' when r_score >= 3 and f_score >= 3 then 'Loyal Customers'
            when r_score >= 4 and f_score <= 2 then 'New Customers' when r_score <= 2 and f_score >= 3 then 'At Risk'
            when r_score <= 2 and f_score <= 2 then 'Lost' else 'Needs Attention' end as segment
from {scored} order by rfm_total desc, customer_unique_id""",
    "payment_method_analysis": f"""with
by_type as (select payment_type, count(*) as n, sum({_cents('payment_value')}) as cents, count(payment_value) as amounts,
                   sum(payment_installments) as parts, count(payment_installments) as known from {{order_payments}} group by payment_type)
select payment_type, n as transaction_count, cents / 100.0D as total_value, {_mean('cents', 'amounts')} as avg_value,
       {_nearest('parts * 10', 'known')} / 10.0D as avg_installments, cast(rank() over (order by cents desc) as bigint) as revenue_rank
from by_type order by revenue_rank, payment_type""",
    "clv_distribution": f"""select count(*) as total_customers, {_mean('sum(monetary_cents)', 'count(monetary_cents)')} as avg_clv,
       {_mean('cast(:two_medians as bigint)', '2')} as median_clv, min(monetary_cents) / 100.0D as min_clv, max(monetary_cents) / 100.0D as max_clv,
       round(stddev_samp(monetary_cents / 100.0D), 2) as stddev_clv
from {{people}}""",
    "review_sentiment": f"""with {_ITEMS}
select category, sum(scores * items) as total_reviews, {_mean('sum(total * items) * 100', 'sum(scores * items)')} as avg_score,
       sum(good * items) as positive_reviews, sum(bad * items) as negative_reviews, {_percent('sum(good * items)', 'sum(scores * items)')} as positive_rate_pct
from sold join reviewed using (order_id) where scores > 0 group by category having sum(scores * items) >= :least_reviews
order by avg_score desc, category""",
}
#: Parameters unless the caller gives others.
DEFAULTS: dict[str, Any] = {"status": "delivered", "top": 10, "top_categories": 15, "least_reviews": 50}


def _scored(people: DataFrame) -> DataFrame:
    metrics = {"r_score": -epoch_micros("last_purchase"), "f_score": F.col("frequency"), "m_score": F.col("monetary_cents")}
    return global_scores(people, metrics, tile_ends)


def _two_medians(people: DataFrame) -> int | None:
    """Sum of the two middle amounts, which are one row for an odd number of persons."""
    n = people.count()
    if not n:
        return None
    middle = [(n + 1) // 2, n // 2 + 1]
    found = at_ranks(people, {"cents": [F.col("monetary_cents")]}, {"cents": middle}, F.col("monetary_cents"))["cents"]
    return sum(found[rank][0] for rank in middle)


def run(spark: SparkSession, star: Star, name: str, **params: Any) -> DataFrame:
    """A report by its name; ``params`` replace the defaults."""
    text, tables = STATEMENTS[name], dict(star.tables())
    known = {**DEFAULTS, **params}
    if "{scored}" in text or "{people}" in text:
        people = materialize(sales_by_person(star), "people")
        if "{scored}" in text:
            tables["scored"] = _scored(people)
        else:
            tables["people"], known["two_medians"] = people, _two_medians(people)
    used = {key: value for key, value in known.items() if f":{key}" in text}
    return run_query(spark, text, used, {key: df for key, df in tables.items() if f"{{{key}}}" in text})
