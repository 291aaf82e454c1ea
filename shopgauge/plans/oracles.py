"""ANSI SQL over the test tables for every query that SQL can express.

The texts follow the definitions of the reports literally (joins that repeat rows, plain windows), not the way
the operators compute them.
"""

from __future__ import annotations

from shopgauge.operators.statements import STATEMENTS
from shopgauge.plans.registry import COHORT_REPORTS
from shopgauge.schema import FEATURES, LABEL, PERSON

VIEWS = """
g_customers as (
  select c_custkey as customer_id,
         case when c_custkey % 10 in (8, 9) then c_custkey - c_custkey % 10 else c_custkey end as customer_unique_id,
         n_name as customer_state
  from customer join nation on c_nationkey = n_nationkey),
g_orders as (
  select o_orderkey as order_id, o_custkey as customer_id,
         case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'processing' end as order_status,
         cast(cast(o_orderdate as date) as timestamp) as order_purchase_timestamp,
         case when o_orderstatus in ('F', 'O') and o_orderkey % 50 <> 7
              then cast(cast(o_orderdate as date) + cast(5 + o_orderkey % 23 + (o_orderkey * 7) % 13 - 6 as int)
                        as timestamp) end as order_delivered_customer_date,
         cast(cast(o_orderdate as date) + cast(7 + o_orderkey % 23 as int) as timestamp)
           as order_estimated_delivery_date
  from orders),
g_payments as (
  select o_orderkey as order_id, 1 as payment_sequential,
         case o_orderpriority when '1-URGENT' then 'credit_card' when '5-LOW' then 'credit_card'
              when '2-HIGH' then 'boleto' when '3-MEDIUM' then 'voucher' else 'debit_card' end as payment_type,
         case when o_orderpriority in ('1-URGENT', '5-LOW') then 1 + o_orderkey % 12 else 1 end
           as payment_installments,
         cast(round(o_totalprice * 100) as bigint) as cents
  from orders),
g_items as (
  select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id, l_suppkey as seller_id,
         cast(round(l_extendedprice * 100) as bigint) as cents
  from lineitem),
g_products as (select p_partkey as product_id, p_type as product_category_name from part),
g_cat as (
  select * from (values ('MEDIUM', 'medium_goods'), ('STANDARD', 'standard_goods'), ('LARGE', 'large_goods'),
                        ('PROMO', 'promo_goods')) t(product_category_name, product_category_name_english)),
g_sellers as (
  select s_suppkey as seller_id, s_name as seller_city, n_name as seller_state
  from supplier join nation on s_nationkey = n_nationkey),
g_reviews as (
  select o_orderkey as review_id, o_orderkey as order_id,
         case when (o_orderkey * 37) % 100 < 11 then 1 when (o_orderkey * 37) % 100 < 17 then 2
              when (o_orderkey * 37) % 100 < 26 then 3 when (o_orderkey * 37) % 100 < 46 then 4 else 5 end
           as review_score
  from orders where o_orderstatus = 'F' and o_orderkey % 10 <> 0
  union all
  select -o_orderkey, o_orderkey, 1 from orders where o_orderstatus = 'F' and o_orderkey % 97 = 1),
dlv as (select *, cast(date_trunc('month', order_purchase_timestamp) as date) as month
        from g_orders where order_status = 'delivered'),
paid as (select d.*, p.cents, p.payment_type, p.payment_installments from dlv d join g_payments p using (order_id)),
person_sales as (
  select c.customer_unique_id, max(p.order_purchase_timestamp) as last_purchase,
         count(distinct p.order_id) as frequency, cast(sum(p.cents) as bigint) as cents
  from paid p join g_customers c using (customer_id) group by 1)"""


def _with(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([VIEWS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def _hu(num: str, den: str) -> str:
    """Nearest integer of a quotient, halves away from zero."""
    return f"cast(sign({num}) * ((2 * abs({num}) + ({den})) // nullif(2 * ({den}), 0)) as bigint)"


def _big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def _money(cents: str) -> str:
    return f"cast({cents} as double) / cast(100 as double)"


def _mean(cents: str, n: str) -> str:
    return _money(_hu(cents, n))


def _pct(part: str, whole: str) -> str:
    return _money(_hu(f"(({part}) * 10000)", whole))


def _ar(x: str, digits: int) -> str:
    """Array-library rounding: scale, half to even, scale back."""
    scale = f"cast({10**digits} as double)"
    return f"round_even(({x}) * {scale}, 0) / {scale}"


def _dbl_ratio(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif(cast({b} as double), 0)"


SALES = {
    "revenue_by_state": _with(f"""
select c.customer_state as state, count(distinct p.order_id) as total_orders,
       {_money('sum(p.cents)')} as total_revenue, {_mean('sum(p.cents)', 'count(p.cents)')} as avg_order_value
from paid p join g_customers c using (customer_id)
group by 1 order by total_revenue desc, state limit 10"""),
    "top_states": _with(f"""
select c.customer_state as state, {_money('sum(p.cents)')} as revenue
from paid p join g_customers c using (customer_id) group by 1 order by revenue desc, state limit 10"""),
    "state_revenue_share": _with(f"""
select state, {_money('cents')} as revenue, {_pct('cents', '(select sum(cents) from by_state)')} as share_pct
from by_state""", """
by_state as (select customer_state as state, sum(cents) as cents from paid join g_customers using (customer_id)
             group by 1)"""),
    "monthly_revenue_growth": _with(f"""
select cast(month as varchar) as month, {_money('cents')} as revenue, {_money('prev')} as prev_month_revenue,
       {_pct('cents - prev', 'prev')} as growth_pct
from (select month, cents, lag(cents) over (order by month) as prev
      from (select month, cast(sum(cents) as bigint) as cents from paid group by 1))"""),
    "revenue_trend": _with(f"""
select strftime(month, '%Y-%m') as month, {_money('sum(cents)')} as revenue, count(distinct order_id) as orders
from paid group by 1"""),
    "cumulative_revenue": _with(f"""
select strftime(month, '%Y-%m') as month, {_money('cents')} as payment_value,
       {_money('sum(cents) over (order by month rows unbounded preceding)')} as cumulative
from (select month, sum(cents) as cents from paid group by 1)"""),
    "top_sellers": _with(f"""
select i.seller_id, s.seller_city, s.seller_state, count(distinct i.order_id) as orders_fulfilled,
       {_money('sum(i.cents)')} as total_revenue, {_mean('sum(i.cents)', 'count(i.cents)')} as avg_item_price
from g_items i join g_sellers s using (seller_id) group by 1, 2, 3 order by total_revenue desc, seller_id limit 10"""),
    "top_categories": _with(f"""
select coalesce(ct.product_category_name_english, p.product_category_name) as category,
       {_money('sum(i.cents)')} as revenue
from g_items i join g_products p using (product_id)
left join g_cat ct on p.product_category_name = ct.product_category_name
where coalesce(ct.product_category_name_english, p.product_category_name) is not null
group by 1 order by revenue desc, category limit 10"""),
    "payment_mix": _with(f"""
select payment_type as type, {_money('sum(cents)')} as value from paid group by 1"""),
    "payment_method_analysis": _with(f"""
select payment_type, count(*) as transaction_count, {_money('sum(cents)')} as total_value,
       {_mean('sum(cents)', 'count(cents)')} as avg_value,
       cast({_hu('sum(payment_installments) * 10', 'count(payment_installments)')} as double) / 10 as avg_installments,
       rank() over (order by sum(cents) desc) as revenue_rank
from g_payments group by 1"""),
    "payment_type_share": _with(f"""
select payment_type, count(*) as payments, {_pct('count(*)', '(select count(*) from g_payments)')} as share_pct
from g_payments group by 1"""),
    "kpis": _with(f"""
select {_money('rev')} as total_revenue, orders as total_orders, people as unique_customers,
       coalesce({_ar(f"{_money('rev')} / nullif(orders, 0)", 2)}, 0) as avg_order_value,
       coalesce({_ar('review', 2)}, 0) as avg_review_score,
       coalesce({_ar(_dbl_ratio('late', 'dated') + ' * 100', 1)}, 0) as late_delivery_pct
from (select (select cast(sum(cents) as bigint) from paid) as rev,
             (select count(distinct order_id) from dlv) as orders,
             (select count(distinct customer_unique_id) from dlv join g_customers using (customer_id)) as people,
             (select cast(sum(review_score) as double) / count(review_score) from g_reviews) as review,
             (select count(*) from dlv where order_delivered_customer_date > order_estimated_delivery_date) as late,
             (select count(*) from dlv where order_delivered_customer_date is not null
                and order_estimated_delivery_date is not null) as dated)"""),
    "recent_orders": _with(f"""
select substr(cast(o.order_id as varchar), 1, 12) || '...' as order_id,
       strftime(o.order_purchase_timestamp, '%Y-%m-%d') as date, c.customer_state as state,
       o.order_status as status, {_money('p.cents')} as value
from (select * from g_orders order by order_purchase_timestamp desc, order_id limit 20) o
left join g_customers c using (customer_id) left join g_payments p using (order_id)"""),
    "dataset_summary": _with(f"""
select (select count(*) from g_customers) as customers, (select count(*) from g_orders) as orders,
       (select count(*) from g_sellers) as sellers,
       (select {_money('sum(cents)')} from g_payments where order_id in (select order_id from dlv))
         as delivered_revenue,
       (select count(distinct customer_state) from g_customers) as unique_states,
       (select {_ar("avg(case when customer_state = 'NATION_3' then 1.0 else 0.0 end) * 100", 1)}
        from g_customers) as focus_share_pct"""),
}

_COHORT = """
first_month as (select customer_unique_id, min(month) as cohort_month
                from dlv join g_customers using (customer_id) group by 1),
cohort_counts as (
  select f.cohort_month,
         cast((year(o.month) - year(f.cohort_month)) * 12 + month(o.month) - month(f.cohort_month) as bigint)
           as month_offset,
         count(distinct f.customer_unique_id) as customers
  from first_month f join g_customers c using (customer_unique_id) join dlv o on o.customer_id = c.customer_id
  group by 1, 2)"""
_COHORT_WINDOW = """
cohort_window as (
  select * from cohort_counts where month_offset <= 5 and cohort_month in
    (select distinct cohort_month from cohort_counts where month_offset <= 5 order by 1 desc limit 8))"""


def _matrix_cell(offset: int) -> str:
    active = f"max(case when month_offset = {offset} then customers end)"
    base = "max(case when month_offset = 0 then customers end)"
    return f"cast(floor(cast({active} as double) / cast({base} as double) * 100 + 0.5) as bigint) as m{offset}"


_RFM_CASE = """case when {champions} then 'Champions' when r_score >= 3 and f_score >= 3 then '{loyal}'
  when r_score >= 4 and f_score <= 2 then 'New Customers' when r_score <= 2 and f_score >= 3 then 'At Risk'
  when r_score <= 2 and f_score <= 2 then 'Lost' else 'Needs Attention' end"""

CUSTOMERS = {
    "cohort_retention_counts": _with("""
select cast(cohort_month as varchar) as cohort_month, month_offset, customers as active_customers
from cohort_counts""", _COHORT),
    "cohort_window": _with("""
select strftime(cohort_month, '%Y-%m') as cohort_month, month_offset, customers from cohort_window""",
                           _COHORT, _COHORT_WINDOW),
    "cohort_matrix": _with(f"""
select strftime(cohort_month, '%Y-%m') as cohort_month, {', '.join(_matrix_cell(o) for o in range(6))}
from cohort_window group by cohort_month""", _COHORT, _COHORT_WINDOW),
    "month_dropoff": _with(f"""
select cast(cohort_month as varchar) as cohort_month, size as cohort_size, active as still_active,
       {_pct('size - active', 'size')} as inactive_pct
from (select cohort_month, coalesce(max(case when month_offset = 0 then customers end), 0) as size,
             coalesce(max(case when month_offset = 2 then customers end), 0) as active
      from cohort_counts group by 1)""", _COHORT),
    "repeat_purchase_rate": _with(f"""
select count(*) as total_customers, {_big('sum(case when n > 1 then 1 else 0 end)')} as repeat_customers,
       {_pct('sum(case when n > 1 then 1 else 0 end)', 'count(*)')} as repeat_purchase_rate_pct
from (select customer_unique_id, count(distinct order_id) as n from dlv join g_customers using (customer_id)
      group by 1)"""),
    "monthly_retention": _with(f"""
select cast(active_month as varchar) as active_month, active_count, retained_count,
       {_pct('retained_count', 'active_count')} as retention_rate_pct
from (select a.active_month, count(distinct a.uid) as active_count, count(distinct b.uid) as retained_count
      from mc a left join mc b on a.uid = b.uid and b.active_month = cast(a.active_month + interval '1' month as date)
      group by 1)""", """
mc as (select distinct customer_unique_id as uid, month as active_month from dlv join g_customers using (customer_id))"""),
    "rfm_segments": _with(f"""
select customer_unique_id, r_score, f_score, m_score, r_score + f_score + m_score as rfm_total,
       {_RFM_CASE.format(champions='r_score >= 4 and f_score >= 4 and m_score >= 4', loyal='Loyal Customers')} as segment
from (select customer_unique_id,
             ntile(5) over (order by last_purchase desc, customer_unique_id) as r_score,
             ntile(5) over (order by frequency, customer_unique_id) as f_score,
             ntile(5) over (order by cents, customer_unique_id) as m_score
      from person_sales)"""),
    "rfm_segment_counts": _with(f"""
select {_RFM_CASE.format(champions='r_score >= 4 and f_score >= 4', loyal='Loyal')} as segment, count(*) as count
from scored group by 1""", """
recency as (select *, date_diff('day', last_purchase, (select max(order_purchase_timestamp) from paid)) as days
            from person_sales),
ordered as (select *, row_number() over (order by days) as rk_r, count(*) over () as n,
                   row_number() over (order by frequency, customer_unique_id) as rk_f,
                   row_number() over (order by cents, customer_unique_id) as rk_m from recency),
edge as (select t, 5 * max(case when rk_r = (t * (n - 1)) // 5 + 1 then days end)
                   + max((t * (n - 1)) % 5) * (max(case when rk_r = least((t * (n - 1)) // 5 + 2, n) then days end)
                                               - max(case when rk_r = (t * (n - 1)) // 5 + 1 then days end)) as e5
         from ordered cross join (values (1), (2), (3), (4)) s(t) group by t),
scored as (select 5 - (select count(*) from edge where 5 * o.days > e5) as r_score,
                  greatest(1, cast(ceil(cast(5 * (rk_f - 1) as double) / (n - 1)) as bigint)) as f_score,
                  greatest(1, cast(ceil(cast(5 * (rk_m - 1) as double) / (n - 1)) as bigint)) as m_score
           from ordered o)"""),
    "rfm_scores": _with("""
select customer_unique_id, cast(days as bigint) as recency, frequency, cents as monetary_cents, f_score, m_score, r_score
from scored""", """
recency as (select *, date_diff('day', last_purchase, (select max(order_purchase_timestamp) from paid)) as days
            from person_sales),
ordered as (select *, count(*) over () as n, row_number() over (order by frequency, customer_unique_id) as rk_f,
                   row_number() over (order by cents, customer_unique_id) as rk_m from recency),
scored as (select *,
                  5 - (select count(*) from unnest([0.2, 0.4, 0.6, 0.8]) q(p)
                       where days > (select quantile_cont(days, [0.2, 0.4, 0.6, 0.8]) from recency)
                                      [cast(round(p * 5) as int)] + 1e-9) as r_score,
                  greatest(1, cast(ceil(cast(5 * (rk_f - 1) as double) / (n - 1)) as bigint)) as f_score,
                  greatest(1, cast(ceil(cast(5 * (rk_m - 1) as double) / (n - 1)) as bigint)) as m_score
           from ordered)"""),
    "clv_distribution": _with(f"""
select count(*) as total_customers, {_mean('sum(cents)', 'count(*)')} as avg_clv,
       {_mean('cast(round(2 * quantile_cont(cents, 0.5)) as bigint)', '2')} as median_clv,
       {_money('min(cents)')} as min_clv, {_money('max(cents)')} as max_clv,
       round(stddev_samp({_money('cents')}), 2) as stddev_clv
from person_sales"""),
}

_FANOUT = """
cat_items as (
  select coalesce(ct.product_category_name_english, p.product_category_name) as category, i.order_id,
         i.order_item_id, i.cents
  from g_items i join g_products p using (product_id)
  left join g_cat ct on p.product_category_name = ct.product_category_name)"""
_SELLER = f"""
sellers as (
  select seller_id, {_money('sum(i.cents)')} as revenue, count(distinct order_id) as orders,
         {_ar(_dbl_ratio('sum(review_score)', 'count(review_score)'), 2)} as avg_review
  from g_items i join dlv using (order_id) left join g_reviews using (order_id)
  group by 1 having count(distinct order_id) >= 5),
late as (
  select seller_id, {_ar(_dbl_ratio(
      'sum(case when order_delivered_customer_date > order_estimated_delivery_date then 1 else 0 end)',
      'count(*)'), 3)} as late_rate
  from g_items join dlv using (order_id)
  where order_delivered_customer_date is not null and order_estimated_delivery_date is not null group by 1),
card as (
  select s.seller_id, s.revenue, s.orders, coalesce(s.avg_review, 0) as avg_review,
         coalesce(l.late_rate, 0) as late_rate
  from sellers s left join late l using (seller_id) order by s.seller_id limit 50)"""

SERVICE = {
    "category_performance": _with(f"""
select category, count(distinct i.order_id) as total_orders, {_big('sum(order_item_id)')} as total_items_sold,
       {_money('sum(cents)')} as total_revenue, {_mean('sum(cents)', 'count(cents)')} as avg_price,
       {_mean('(sum(review_score) * 100)', 'count(review_score)')} as avg_review_score
from cat_items i left join g_reviews r using (order_id) group by 1 order by total_revenue desc, category limit 15""",
                                  _FANOUT),
    "review_sentiment": _with(f"""
select category, count(*) as total_reviews, {_mean('(sum(review_score) * 100)', 'count(*)')} as avg_score,
       {_big('sum(case when review_score >= 4 then 1 else 0 end)')} as positive_reviews,
       {_big('sum(case when review_score <= 2 then 1 else 0 end)')} as negative_reviews,
       {_pct('sum(case when review_score >= 4 then 1 else 0 end)', 'count(*)')} as positive_rate_pct
from g_reviews r join cat_items i using (order_id) where review_score is not null
group by 1 having count(*) >= 50""", _FANOUT),
    "delivery_performance": _with(f"""
select customer_state, count(*) as total_orders, {_big('sum(late)')} as late_orders,
       {_pct('sum(late)', 'count(*)')} as late_pct,
       cast({_hu('sum(seconds)', '(count(*) * 8640)')} as double) / 10 as avg_delivery_days
from (select customer_state,
             case when order_delivered_customer_date <= order_estimated_delivery_date then 0 else 1 end as late,
             date_diff('second', order_purchase_timestamp, order_delivered_customer_date) as seconds
      from dlv join g_customers using (customer_id) where order_delivered_customer_date is not null)
group by 1"""),
    "seller_scorecard": _with("select * from card", _SELLER),
    "seller_late_flag": _with("select seller_id, late_rate, late_rate > 0.3 as is_risky from card", _SELLER),
    "late_vs_review": _with("""
select round(on_time, 4) as on_time_score, round(late, 4) as late_score, round(on_time - late, 4) as gap
from (select avg(case when order_delivered_customer_date <= order_estimated_delivery_date
                      then cast(review_score as double) end) as on_time,
             avg(case when order_delivered_customer_date > order_estimated_delivery_date
                      then cast(review_score as double) end) as late
      from dlv join g_reviews using (order_id)
      where order_delivered_customer_date is not null and order_estimated_delivery_date is not null)"""),
    "seller_pareto": _with(f"""
select n as sellers, count(*) as top_sellers, {_money('sum(cents)')} as top_revenue, {_money('total')} as total_revenue,
       {_pct('sum(cents)', 'total')} as top_share_pct
from (select cents, row_number() over (order by cents desc, seller_id) as rk, count(*) over () as n,
             sum(cents) over () as total
      from (select seller_id, sum(cents) as cents from g_items group by 1))
where rk <= (n * 20 + 99) // 100 group by n, total"""),
}



SOURCES = {
    "load_star": _with("""
select table_name, row_count, row_count as keyed_rows, cast(value_sum as bigint) as value_sum from (
  select 'customers' as table_name, count(*) as row_count, count(customer_state) as value_sum from g_customers
  union all select 'orders', count(*), sum(date_diff('day', date '1970-01-01', cast(order_purchase_timestamp as date))
    + coalesce(date_diff('day', date '1970-01-01', cast(order_delivered_customer_date as date)), 0)) from g_orders
  union all select 'sellers', count(*), count(seller_state) from g_sellers
  union all select 'products', count(*), count(product_category_name) from g_products
  union all select 'category_translation', count(*), count(product_category_name_english) from g_cat
  union all select 'order_items', count(*), sum(cents) from g_items
  union all select 'order_payments', count(*), sum(cents + payment_installments) from g_payments
  union all select 'order_reviews', count(*), sum(review_score) from g_reviews)"""),
    "normalize_headers": _with("select order_id, payment_type from g_payments"),
    "parse_timestamps": _with("""
select order_id, cast(order_purchase_timestamp as varchar) as purchased,
       case when order_id % 10 <> 3 then cast(order_delivered_customer_date as varchar) end as delivered
from g_orders"""),
    "write_table": _with("select order_id, order_status from g_orders where order_status <> 'shipped'"),
    "bucketed_join": _with("""
select order_id, any_value(order_status) as order_status, count(*) as payments, cast(sum(cents) as bigint) as paid_cents
from g_orders join g_payments using (order_id) group by 1"""),
    "run_query": _with("""
select payment_type, count(*) as payments from g_payments join g_orders using (order_id)
where order_status = 'shipped' and payment_installments >= 1 group by 1"""),
    "load_trials": """
select user_id as study, event_id as number, case when event_type <> 'error' then value / 1000 end as value,
       case when event_type = 'error' then 'FAIL' else 'COMPLETE' end as state,
       50 + event_id % 251 as n_estimators, 3 + event_id % 8 as max_depth,
       cast(1 + event_id % 30 as double) / 100 as learning_rate
from events""",
}

_FEATURES = """
split as (select *, case when order_purchase_timestamp
                              <= (select max(order_purchase_timestamp) - interval 90 day from dlv)
                         then 'obs' else 'pred' end as win from dlv),
obs as (select s.*, c.customer_unique_id as uid, c.customer_state as state
        from split s join g_customers c using (customer_id) where win = 'obs'),
base as (select uid, count(distinct order_id) as frequency, max(order_purchase_timestamp) as last_ts,
                min(order_purchase_timestamp) as first_ts from obs group by 1),
first_state as (select uid, state from (select uid, state, row_number() over
                  (partition by uid order by order_purchase_timestamp, customer_id) as k from obs) where k = 1),
pay as (select uid, cast(coalesce(sum(cents), 0) as double) / 100 as monetary,
               cast(sum(cents) as double) / 100 / count(cents) as avg_order_value,
               cast(sum(payment_installments) as double) / count(payment_installments) as avg_installments,
               count(distinct payment_type) as payment_type_count
        from obs left join g_payments using (order_id) group by 1),
rev as (select uid, coalesce(cast(sum(review_score) as double) / nullif(count(review_score), 0), 3.0)
                      as avg_review_score, count(review_score) as review_count
        from obs left join g_reviews using (order_id) group by 1),
back as (select distinct customer_unique_id as uid from split join g_customers using (customer_id)
         where win = 'pred'),
timing as (select uid, frequency, date_diff('day', first_ts, last_ts) as tenure_days,
                  case when frequency > 1
                       then cast(date_diff('day', first_ts, last_ts) as double) / (frequency - 1)
                       else 365.0 end as avg_days_between_orders from base),
codes as (select state, row_number() over (order by state) - 1 as code
          from (select distinct state from first_state)),
features as (
  select b.uid as customer_unique_id, b.frequency, monetary, avg_order_value, avg_installments, payment_type_count,
         cast(avg_review_score as double) as avg_review_score, review_count, t.tenure_days,
         cast(t.avg_days_between_orders as double) as avg_days_between_orders,
         coalesce(code, -1) as state_encoded,
         case when b.uid in (select uid from back) then cast(0 as bigint) else cast(1 as bigint) end as is_churned
  from base b join timing t using (uid) join first_state s using (uid) left join codes using (state)
  left join pay using (uid) left join rev using (uid)
  where avg_order_value is not null and avg_installments is not null),
scored as (select *, cast((customer_unique_id * 37 + frequency * 113) % 1001 as double) / 1000 as p from features)"""


def _features(body: str, *ctes: str) -> str:
    return _with(body, _FEATURES, *ctes)


_BATCH = "case when p > 0 and p <= 0.4 then 'LOW' when p > 0.4 and p <= 0.7 then 'MEDIUM' when p > 0.7 then 'HIGH' end"
_SINGLE = "case when p >= 0.7 then 'HIGH' when p >= 0.4 then 'MEDIUM' else 'LOW' end"

_REQUESTS = """
asked as (
  select customer_unique_id as u, customer_unique_id,
         case when customer_unique_id % 13 = 1 then null when customer_unique_id % 17 = 2 then 0 else frequency end
           as frequency,
         case when customer_unique_id % 19 = 3 then -1.0 else monetary end as monetary,
         avg_order_value,
         case when customer_unique_id % 23 = 4 then 0.5 else avg_installments end as avg_installments,
         payment_type_count,
         coalesce(case when customer_unique_id % 7 = 5 then null when customer_unique_id % 29 = 6 then 5.5
                       else avg_review_score end, 3.0) as avg_review_score,
         coalesce(case when customer_unique_id % 11 = 7 then null else review_count end, 0) as review_count,
         tenure_days,
         coalesce(case when customer_unique_id % 5 = 0 then null else avg_days_between_orders end, 90.0)
           as avg_days_between_orders,
         case when customer_unique_id % 31 = 8 then -1 else state_encoded end as state_encoded
  from features)"""
_VIOLATIONS = """concat_ws('; ',
  case when frequency is null then 'frequency: missing' end,
  case when frequency < 1 then 'frequency: below 1' end,
  case when monetary < 0 then 'monetary: below 0' end,
  case when avg_order_value < 0 then 'avg_order_value: below 0' end,
  case when avg_installments < 1 then 'avg_installments: below 1' end,
  case when payment_type_count < 1 then 'payment_type_count: below 1' end,
  case when avg_review_score < 1 then 'avg_review_score: below 1' end,
  case when avg_review_score > 5 then 'avg_review_score: above 5' end,
  case when review_count < 0 then 'review_count: below 0' end,
  case when tenure_days < 0 then 'tenure_days: below 0' end,
  case when avg_days_between_orders < 0 then 'avg_days_between_orders: below 0' end,
  case when state_encoded < 0 then 'state_encoded: below 0' end)"""

_SHUFFLED = """
shuffled as (select *, row_number() over (partition by is_churned order by
                         md5(cast(customer_unique_id as varchar) || '#42'), customer_unique_id) as rk,
                    count(*) over (partition by is_churned) as n from features)"""
_CONFUSION = """
conf as (select sum(case when p >= 0.5 and is_churned = 1 then 1 else 0 end) as tp,
                sum(case when p >= 0.5 and is_churned = 0 then 1 else 0 end) as fp,
                sum(case when p < 0.5 and is_churned = 1 then 1 else 0 end) as fn,
                sum(case when p < 0.5 and is_churned = 0 then 1 else 0 end) as tn from scored),
rates as (select *, cast(tp as double) / nullif(tp + fp, 0) as p1, cast(tp as double) / nullif(tp + fn, 0) as r1,
                 cast(tn as double) / nullif(tn + fn, 0) as p0, cast(tn as double) / nullif(tn + fp, 0) as r0,
                 cast(tp + tn as double) / (tp + tn + fp + fn) as acc from conf),
f as (select *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) as f1,
             coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f0, tp + fn as s1, tn + fp as s0 from rates)"""


def _report_row(name: str, precision: str, recall: str, f1: str, support: str) -> str:
    return (f"select '{name}' as class, {_ar(precision, 2)} as precision, {_ar(recall, 2)} as recall, "
            f"{_ar(f1, 2)} as f1, {_big(support)} as support from f")


def _weighted(name0: str, name1: str) -> str:
    return f"({name0} * s0 + {name1} * s1) / (s0 + s1)"


_HIST = [(i / 10, (i + 1) / 10) for i in range(10)]

CHURN = {
    "temporal_split": _features("""
select win as window, count(*) as orders, cast(min(order_purchase_timestamp) as varchar) as first_order,
       cast(max(order_purchase_timestamp) as varchar) as last_order from split group by 1"""),
    "order_features": _features("""
select uid as customer_unique_id, state as customer_state, frequency, cast(last_ts as varchar) as last_obs_purchase,
       cast(first_ts as varchar) as first_purchase from base join first_state using (uid)"""),
    "payment_features": _features("select uid as customer_unique_id, * exclude (uid) from pay"),
    "review_features": _features("select uid as customer_unique_id, * exclude (uid) from rev"),
    "tenure_and_gap": _features("select uid as customer_unique_id, * exclude (uid) from timing"),
    "churn_label": _features("""
select uid as customer_unique_id, cast(case when uid in (select uid from back) then 0 else 1 end as bigint) as is_churned
from base"""),
    "state_encoding": _features("""
select uid as customer_unique_id, state as customer_state, code as state_encoded
from first_state join codes using (state)"""),
    "churn_features": _features(f"select {PERSON}, {', '.join(FEATURES)}, {LABEL} from features"),
    "churn_rate_check": _features("""
select count(*) as customers, round(avg(cast(is_churned as double)) * 100, 4) as churn_rate_pct,
       avg(cast(is_churned as double)) * 100 between 10 and 50 as in_band from features"""),
    "validate_features": _features(f"""
select customer_unique_id, {', '.join(FEATURES)}, {_VIOLATIONS} as violations, {_VIOLATIONS} = '' as is_valid
from asked""", _REQUESTS),
    "risk_bands": _features(f"""
select customer_unique_id, p as probability, {_BATCH} as batch_band, {_SINGLE} as single_band, p >= 0.5 as is_churned
from scored"""),
    "high_risk_top20": _features(f"""
select row_number() over (order by p desc, customer_unique_id) as customer_rank, customer_unique_id,
       {_ar('p', 4)} as churn_probability, {_BATCH} as risk_level, frequency, {_ar('monetary', 2)} as monetary,
       {_ar('avg_days_between_orders', 1)} as avg_days_between_orders
from scored order by p desc, customer_unique_id limit 20"""),
    "risk_histogram": _features(" union all ".join(
        f"select '{lo}-{hi}' as range, count(*) as count, '{'LOW' if hi <= 0.4 else 'MEDIUM' if hi <= 0.7 else 'HIGH'}'"
        f" as tier from scored where p >= {lo} and p {'<=' if hi == 1 else '<'} {hi}" for lo, hi in _HIST)),
    "batch_score": _features(f"""
select customer_unique_id, {_ar('p', 4)} as churn_probability, p >= 0.5 as is_churned, {_SINGLE} as risk_level
from scored"""),
    "binary_metrics": _features(f"""
select {_ar('acc', 4)} as accuracy, {_ar('coalesce(p1, 0)', 4)} as precision, {_ar('coalesce(r1, 0)', 4)} as recall,
       {_ar('f1', 4)} as f1, {_ar('auc', 4)} as roc_auc
from f, (select (cast(sum(case when is_churned = 1 then mid end) as double) - pos * (pos + 1) / 2) / (pos * neg) as auc
         from (select is_churned, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 as mid,
                      cast(sum(is_churned) over () as double) as pos,
                      cast(sum(1 - is_churned) over () as double) as neg from scored)
         group by pos, neg)""", _CONFUSION),
    "classification_report": _features(" union all ".join([
        _report_row("Active", "coalesce(p0, 0)", "coalesce(r0, 0)", "f0", "s0"),
        _report_row("Churned", "coalesce(p1, 0)", "coalesce(r1, 0)", "f1", "s1"),
        _report_row("accuracy", "acc", "acc", "acc", "s0 + s1"),
        _report_row("macro avg", "(coalesce(p0, 0) + coalesce(p1, 0)) / 2", "(coalesce(r0, 0) + coalesce(r1, 0)) / 2",
                    "(f0 + f1) / 2", "s0 + s1"),
        _report_row("weighted avg", _weighted("coalesce(p0, 0)", "coalesce(p1, 0)"),
                    _weighted("coalesce(r0, 0)", "coalesce(r1, 0)"), _weighted("f0", "f1"), "s0 + s1"),
    ]), _CONFUSION),
}

LEARNING = {
    "stratified_split": _features("""
select customer_unique_id, is_churned,
       case when rk <= (2 * n * 20 + 100) // 200 then 'test' else 'train' end as part from shuffled""", _SHUFFLED),
    "stratified_folds": _features("""
select customer_unique_id, is_churned, (rk - 1) % 3 as fold from shuffled""", _SHUFFLED),
    "save_load_model": _features("select count(*) as compared, cast(0 as bigint) as different from features"),
    # The label of these is payment_type_count >= 3, so that the model must answer it, by that feature alone.
    "rule_train_churn": """
select unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) as metric, cast(1 as double) as value""",
    "rule_feature_importance": f"""
select feature, case when feature = 'payment_type_count' then 1.0::double else 0.0::double end as importance
from (select unnest({FEATURES}) as feature)""",
    # The test part, each person with the rule's answer for the next one in the random order: two scores, so the area under
    # the curve is the mean of the shares that are right in either class.
    "rule_permutation_importance": _features(f"""
select feature, case when feature = 'payment_type_count' then round_even(1 - area, 4) else 0.0::double end as auc_drop
from (select unnest({FEATURES}) as feature), areas""", """
labelled as (select customer_unique_id, payment_type_count >= 3 as y from features),
ranked as (select *, md5(cast(customer_unique_id as varchar) || '#42') as k,
                  row_number() over (partition by y order by md5(cast(customer_unique_id as varchar) || '#42'), customer_unique_id) as rk,
                  count(*) over (partition by y) as n from labelled),
tested as (select y, coalesce(lead(y) over w, first_value(y) over w) as other
           from ranked where rk <= (2 * n * 20 + 100) // 200
           window w as (order by k, customer_unique_id rows between unbounded preceding and unbounded following)),
areas as (select (avg(case when other then 1.0 else 0.0 end) filter (y)
                  + avg(case when other then 0.0 else 1.0 end) filter (not y)) / 2 as area from tested)"""),
    "rule_run_log": """
select 'churn-model' as run_name, unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) as metric, cast(1 as double) as value""",
    "rule_batch_score": _features("""
select customer_unique_id, payment_type_count >= 3 as is_churned,
       case when payment_type_count >= 3 then 'HIGH' else 'LOW' end as risk_level from features"""),
    "rule_risk_histogram": _features(" union all ".join(
        f"select '{lo}-{hi}' as range, count(*) as count, '{'LOW' if hi <= 0.4 else 'MEDIUM' if hi <= 0.7 else 'HIGH'}'"
        f" as tier from features where {'payment_type_count < 3' if lo == 0 else 'payment_type_count >= 3' if hi == 1 else 'false'}"
        for lo, hi in _HIST)),
    "trial_running_max": """
select user_id as study, event_id as number,
       greatest(0.0, max(case when event_type <> 'error' then value / 1000 else 0.0 end)
                       over (partition by user_id order by event_id rows unbounded preceding)) as running_max
from events""",
    "best_trial": """
select study, number, value
from (select user_id as study, event_id as number, case when event_type <> 'error' then value / 1000 end as value,
             row_number() over (partition by user_id order by
               case when event_type <> 'error' then value / 1000 else 0.0 end desc, event_id) as k
      from events) where k = 1""",
}

# Experiments: tail probabilities are integrated numerically (Simpson's rule), independently of the library's
# error function and continued fraction.
_Z975, _Z80 = "1.959963984540054", "0.8416212335729143"
_UNITS = """
user_days as (select user_id, cast(ts as date) as dt, list(event_type) as kinds from events group by 1, 2),
rate_units as (
  select kind || '_rate' as experiment, 'days with ' || kind as metric,
         case when user_id % 2 = 0 then 'control' else 'treatment' end as arm,
         case when list_contains(kinds, kind) then 1.0::double else 0.0::double end as outcome
  from user_days cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) k(kind)),
value_units as (
  select event_type || '_value' as experiment, 'value of ' || event_type as metric,
         case when user_id % 2 = 0 then 'control' else 'treatment' end as arm,
         value as outcome from events),
units as (select * from rate_units union all select * from value_units),
arms as (select experiment, metric, arm, count(outcome) as n, sum(outcome) as total, avg(outcome) as mean,
                var_samp(outcome) as variance, stddev_samp(outcome) as std from units group by 1, 2, 3),
sides as (select c.experiment, c.metric, c.n as n1, t.n as n2, c.total as x1, t.total as x2, c.mean as m1, t.mean as m2,
                 c.variance as v1, t.variance as v2, cast(least(c.n, t.n) as double) as n_min
          from arms c join arms t using (experiment, metric) where c.arm = 'control' and t.arm = 'treatment'),
steps as (select cast(i as double) as i,
                 case when i in (0, 4000) then 1.0::double when i % 2 = 1 then 4.0::double else 2.0::double end as w
          from range(0, 4001) r(i))"""
_RATES = f"""
rates as (
  select *, (n1 + n2) * power(greatest(abs(x1 * (n2 - x2) - (n1 - x1) * x2) - (n1 + n2) / 2.0, 0), 2)
              / (cast(n1 as double) * n2 * (x1 + x2) * (n1 + n2 - x1 - x2)) as chi2,
         sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2) as se,
         sqrt(2 * ((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) / n_min) as se0
  from sides where experiment like '%_rate'),
rate_args as (select *, (abs(m2 - m1) - {_Z975} * se0) / se as arg,
                     ({_Z975} + {_Z80}) * sqrt(2 * m1 * (1 - m1) / n_min) as mde from rates)"""


def _phi(arg: str) -> str:
    """Normal distribution function: one half plus Simpson's integral of the density from 0."""
    return (f"(0.5 + (select sum(w * exp(-power(({arg}) * i / 4000, 2) / 2)) * ({arg}) / 4000 / 3 from steps)"
            f" / sqrt(2 * pi()))")


def _t_below(t: str, df: str) -> str:
    """P(0 < T < t) of Student's law by Simpson's rule."""
    return (f"((select sum(w * power(1 + power(({t}) * i / 4000, 2) / ({df}), -(({df}) + 1) / 2)) * ({t}) / 4000 / 3"
            f" from steps) * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi() * ({df})))")


_MEANS = f"""
means as (
  select *, v1 / n1 as a1, v2 / n2 as a2, sqrt(v1 / n1 + v2 / n2) as se, n_min - 1 as ci_df
  from sides where experiment like '%_value'),
mean_args as (select *, (m1 - m2) / se as t, power(a1 + a2, 2) / (power(a1, 2) / (n1 - 1) + power(a2, 2) / (n2 - 1)) as df,
                     (abs(m2 - m1) - {_Z975} * se) / se as arg,
                     ({_Z975} + {_Z80}) * sqrt((v1 + v2) / 2) * sqrt(1.0::double / n1 + 1.0::double / n2) as mde
              from means),
bisect(experiment, ci_df, lo, hi, k) as (
  select experiment, ci_df, 0.0::double, 64.0::double, 0 from means
  union all
  select experiment, ci_df, case when below < 0.475 then mid else lo end, case when below < 0.475 then hi else mid end,
         k + 1
  from (select b.*, (lo + hi) / 2 as mid,
               (sum(s.w * power(1 + power((lo + hi) / 2 * s.i / 4000, 2) / ci_df, -(ci_df + 1) / 2))
                  * (lo + hi) / 2 / 4000 / 3) * exp(lgamma((ci_df + 1) / 2) - lgamma(ci_df / 2))
                 / sqrt(pi() * ci_df) as below
        from bisect b cross join steps s where k < 45 group by b.experiment, b.ci_df, b.lo, b.hi, b.k)),
critical as (select experiment, (lo + hi) / 2 as t_critical from bisect where k = 45)"""


def _units(body: str, *ctes: str) -> str:
    return "with recursive " + ",\n".join([c.strip() for c in (_UNITS, *ctes)]) + "\n" + body.strip()


_RATE_REPORT = f"""
select experiment as experiment_name, metric as metric_name, n1 as control_size, n2 as treatment_size,
       {_ar('m1', 5)} as control_mean, {_ar('m2', 5)} as treatment_mean, {_ar('m2 - m1', 5)} as absolute_lift,
       {_ar('case when m1 > 0 then (m2 - m1) / m1 * 100 else 0 end', 2)} as relative_lift_pct,
       {_ar('chi2', 4)} as test_statistic, {_ar('pv', 6)} as p_value,
       {_ar(f'm2 - m1 - {_Z975} * se', 5)} as ci_lower, {_ar(f'm2 - m1 + {_Z975} * se', 5)} as ci_upper,
       pv < 0.05 as is_significant, {_ar('mde', 5)} as mde, {_ar('power', 4)} as statistical_power,
       'chi_square' as test_type
from (select *, 2 * (1 - {_phi('sqrt(chi2)')}) as pv, {_phi('arg')} as power from rate_args)"""
_MEAN_REPORT = f"""
select experiment as experiment_name, metric as metric_name, n1 as control_size, n2 as treatment_size,
       {_ar('m1', 2)} as control_mean, {_ar('m2', 2)} as treatment_mean, {_ar('m2 - m1', 2)} as absolute_lift,
       {_ar('case when m1 > 0 then (m2 - m1) / m1 * 100 else 0 end', 2)} as relative_lift_pct,
       {_ar('t', 4)} as test_statistic, {_ar('pv', 6)} as p_value,
       {_ar('m2 - m1 - t_critical * se', 4)} as ci_lower, {_ar('m2 - m1 + t_critical * se', 4)} as ci_upper,
       pv < 0.05 as is_significant, {_ar('mde', 4)} as mde, {_ar('power', 4)} as statistical_power,
       't_test' as test_type
from (select *, 1 - 2 * {_t_below('abs(t)', 'df')} as pv, {_phi('arg')} as power
      from mean_args join critical using (experiment))"""
_REPORT = f"report as ({_RATE_REPORT} union all {_MEAN_REPORT})"

EXPERIMENTS = {
    "arm_statistics": _units("""
select experiment, arm, n, round(total, 6) as total, round(mean, 6) as mean, round(variance, 6) as variance,
       round(std, 6) as std from arms"""),
    "proportion_test": _units(f"""
select experiment, round(chi2, 8) as test_statistic, round(2 * (1 - {_phi('sqrt(chi2)')}), 8) as p_value
from rate_args""", _RATES),
    "proportion_ci": _units(f"""
select experiment, round(m2 - m1 - {_Z975} * se, 8) as ci_lower, round(m2 - m1 + {_Z975} * se, 8) as ci_upper
from rate_args""", _RATES),
    "lift": _units("""
select experiment, round(m2 - m1, 8) as absolute_lift,
       round(case when m1 > 0 then (m2 - m1) / m1 * 100 else 0 end, 6) as relative_lift_pct from rate_args""", _RATES),
    "welch_t_test": _units(f"""
select experiment, round(t, 6) as test_statistic, round(df, 3) as degrees_of_freedom,
       round(1 - 2 * {_t_below('abs(t)', 'df')}, 6) as p_value from mean_args""", _MEANS),
    "mean_ci": _units("""
select experiment, round(t_critical, 6) as t_critical, round(m2 - m1 - t_critical * se, 5) as ci_lower,
       round(m2 - m1 + t_critical * se, 5) as ci_upper from mean_args join critical using (experiment)""", _MEANS),
    "mde_proportion": _units("select experiment, round(mde, 8) as mde from rate_args", _RATES),
    "mde_mean": _units("select experiment, round(mde, 6) as mde from mean_args", _MEANS),
    "power_proportion": _units(f"""
select experiment, round(arg, 7) as power_argument, round({_phi('arg')}, 7) as statistical_power
from rate_args""", _RATES),
    "power_mean": _units(f"""
select experiment, round(arg, 6) as power_argument, round({_phi('arg')}, 6) as statistical_power
from mean_args""", _MEANS),
    "experiment_report": _units("select * from report", _RATES, _MEANS, _REPORT),
    "significance_verdict": _units("""
select experiment_name, is_significant,
       case when is_significant
            then 'We reject H₀ — the treatment effect is statistically significant at α=0.05. The '
                 || regexp_replace(cast(relative_lift_pct as varchar), '\\.0$', '') || '% lift is real.'
            else 'We fail to reject H₀ — insufficient evidence at α=0.05. The observed lift of '
                 || regexp_replace(cast(relative_lift_pct as varchar), '\\.0$', '') || '% may be due to chance.' end
         as verdict
from report""", _RATES, _MEANS, _REPORT),
    "sample_size_grid": _units("""
select experiment, base_pct, lift_pct,
       case when p2 <= 1 and b > 0 then cast(ceil(power(1.96 * sqrt(greatest(2 * pm * (1 - pm), 0))
                                              + 0.84 * sqrt(greatest(b * (1 - b) + p2 * (1 - p2), 0)), 2)
                                        / power(p2 - b, 2)) as bigint) end as per_arm
from (select *, (b + p2) / 2 as pm
      from (select experiment, base_pct, lift_pct, base_pct / 100.0::double as b,
                   (base_pct / 100.0::double) * (1 + lift_pct / 100.0::double) as p2
            from (select experiment, cast(floor(m1 * 100 + 0.5) as bigint) as base_pct, lift_pct
                  from rate_args cross join range(5, 101) l(lift_pct))))""", _RATES),
}


def all_oracles() -> dict[str, str]:
    reports = {**SOURCES, **SALES, **CUSTOMERS, **SERVICE, **CHURN, **LEARNING, **EXPERIMENTS}
    # A report's own SQL text must answer as the report does.
    # So must the reports out of stored sketches and months, which are exact on the test tables.
    stored = {f"sketched_{name}": reports[name] for name in COHORT_REPORTS} | {"churn_features_by_month": reports["churn_features"]}
    return reports | {f"sql_{name}": reports[name] for name in STATEMENTS} | stored
