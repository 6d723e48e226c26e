"""DuckDB twins of the registered queries, written independently in SQL.

Nothing is imported from the operators: thresholds, smoother weights and rule
conditions are written out again here.
Where Spark combines to the finest grain before fanning out to the scope
levels, these expand the raw lines to the four levels first.
"""

from __future__ import annotations

SALES = """sales as (
  select n_name as store, cast(l_shipdate as date) as sale_date,
         cast(l_partkey as varchar) as article, p_name as description,
         concat_ws(' ', p_brand, p_type) as model, p_type as segment,
         l_extendedprice / l_quantity as price,
         cast(l_quantity as decimal(18,2)) as qty,
         cast(l_extendedprice as decimal(18,2)) as amount,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey)"""

SCOPED = """scoped as (
  select * from sales where store is not null and segment is not null
  union all select * replace ('*' as store) from sales where segment is not null
  union all select * replace ('*' as segment) from sales where store is not null
  union all select * replace ('*' as store, '*' as segment) from sales)"""

DAILY = """daily as (
  select store, segment, sale_date as ds, cast(sum(qty) as double) as y,
         coalesce(sum(amount), 0) as amount, count(*) as lines
  from scoped group by store, segment, sale_date)"""

WINSOR = """quart as (
  select store, segment, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3,
         count(*) as n
  from daily group by store, segment),
clipped as (
  select d.store, d.segment, d.ds, d.y as y_raw,
         case when n >= 4 then least(greatest(d.y, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))
              else d.y end as y
  from daily d join quart q on d.store = q.store and d.segment = q.segment)"""

PREPARED = """prepared as (
  select store, segment, ds, y_raw, greatest(y, 0) as y from clipped)"""

DIRTY = """dirty as (
  select store as Magazin,
         case when k = 5 then 'unknown'
              when k = 6 then strftime(sale_date, '%d/%m/%Y')
              when k = 7 then strftime(sale_date, '%Y-%m-%d')
              when k = 17 then strftime(sale_date, '%d-%m-%Y')
              when k = 18 then strftime(sale_date, '%d.%m.%y')
              when k = 19 then strftime(sale_date, '%d/%m/%Y') || ' 10:00:00'
              when k = 20 then strftime(sale_date, '%Y-%m-%d') || 'T10:00:00'
              when k = 21 then strftime(sale_date, '%d.%m.%Y') || ' 10:30'
              else strftime(sale_date, '%d.%m.%Y') end as Datasales,
         article as Art, description as "Describe", model as Model, segment as Segment,
         case when k = 0 then 'n/a' when k = 1 then '0' when k = 9 then '1,5'
              when k = 10 then 'nan' when k = 11 then '12.5d'
              else cast(micro // 1000000 as varchar) || '.' || lpad(cast(micro % 1000000 as varchar), 6, '0') end as Price,
         case when k = 2 then '-1' when k = 3 then '0'
              when k = 8 then '  ' || cast(qty as varchar) || ' '
              when k = 12 then '-0.004' when k = 13 then '0.125' when k = 15 then '1e23'
              else cast(qty as varchar) end as Qty,
         case when k = 4 then '' when k = 14 then '1e16' when k = 16 then '1e30'
              else cast(amount as varchar) end as "Sum", k
  from (select *, (l_orderkey + l_partkey) % 50 as k,
               (cast(round(amount * 100) as bigint) * 20000 + cast(qty as bigint)) // (cast(qty as bigint) * 2) as micro
        from sales)),
parsed as (
  select Magazin as store,
         cast(case when regexp_matches(trim(Datasales), '^[0-9]+[.][0-9]+[.][0-9]{2}$') then try_strptime(trim(Datasales), '%d.%m.%y')
                   else try_strptime(trim(Datasales), ['%d.%m.%Y', '%d/%m/%Y', '%Y-%m-%d', '%d-%m-%Y',
                         '%d/%m/%Y %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%d.%m.%Y %H:%M']) end as date) as sale_date,
         Art as article, "Describe" as description, Model as model, Segment as segment,
         case when regexp_matches(trim(Price), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
              then try_cast(trim(Price) as double) end as price,
         case when regexp_matches(trim(Qty), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
              then try_cast(trim(Qty) as double) end as qty_number,
         case when regexp_matches(trim("Sum"), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
              then try_cast(trim("Sum") as double) end as amount_number,
         try_cast(qty_number as decimal(28,6)) as qty, try_cast(amount_number as decimal(28,6)) as amount, k
  from dirty)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


# Exponential average, span 7: a = 1/4; weights beyond 137 rows are under 1e-17.
EMA_7 = """select store, segment, ds, y_raw,
  greatest(list_reduce(list(y_raw) over (partition by store, segment order by ds
           rows between 137 preceding and current row),
           lambda acc, x: 0.25 * x + 0.75 * acc), 0) as y
from (select store, segment, ds, y as y_raw from daily)"""

# Savitzky-Golay, window 7, cubic: weights in 42nds, by place of the row in its window.
SAVGOL_7 = """select store, segment, ds, y_raw,
  greatest(case when n < 7 then y_raw
       when i < 3 then list_dot_product(wide[1:7], weights[i + 1]) / 42
       when i >= n - 3 then list_dot_product(wide[-7:], weights[7 - (n - i) + 1]) / 42
       else list_dot_product(centred, weights[4]) / 42 end, 0) as y
from (select store, segment, ds, y as y_raw,
        [[39, 8, -4, -4, 1, 4, -2], [8, 19, 16, 6, -4, -7, 4], [-4, 16, 19, 12, 2, -4, 1],
         [-4, 6, 12, 14, 12, 6, -4],
         [1, -4, 2, 12, 19, 16, -4], [4, -7, -4, 6, 16, 19, 8], [-2, 4, 1, -4, -4, 8, 39]]::double[][] as weights,
        row_number() over w - 1 as i, count(*) over (partition by store, segment) as n,
        list(y) over (w rows between 3 preceding and 3 following) as centred,
        list(y) over (w rows between 6 preceding and 6 following) as wide
      from daily window w as (partition by store, segment order by ds))"""


ORACLE: dict[str, str] = {
    "load_sales": with_(SALES, DIRTY) + """
select store, sale_date, article, description, model, segment, price,
       cast(qty as double) as qty, cast(amount as double) as amount
from parsed where sale_date is not null and qty_number >= 0 and price > 0
  and qty is not null and (amount_number is null or amount is not null)""",

    "rejection_counts": with_(SALES, DIRTY) + """
select outcome, count(*) as lines from (
  select case when sale_date is null then 'bad_date'
              when price is null then 'bad_price'
              when price <= 0 then 'price_not_positive'
              when qty_number is null then 'bad_qty'
              when qty_number < 0 then 'qty_negative'
              when qty is null then 'qty_too_large'
              when amount_number is not null and amount is null then 'amount_too_large'
              else 'accepted' end as outcome
  from parsed) group by outcome""",

    "list_stores": with_(SALES) + "select distinct store from sales where store is not null",
    "list_segments": with_(SALES) + "select distinct segment from sales where segment is not null",
    "filter_scope": with_(SALES) + """
select store, sale_date, article, description, model, segment, price,
       cast(qty as double) as qty, cast(amount as double) as amount
from sales where store = 'NATION_12' and segment = 'PROMO'""",
    "segments_of_store": with_(SALES) + """
select distinct segment from sales where store = 'NATION_12' and segment is not null""",
    "min_rows_guard": with_(SALES, SCOPED) + """
select store, segment, count(*) as lines from scoped group by store, segment having count(*) >= 10""",

    "daily_sales": with_(SALES, SCOPED) + """
select store, segment, sale_date as ds, cast(sum(qty) as double) as y,
       cast(coalesce(sum(amount), 0) as double) as amount, count(*) as lines
from scoped group by store, segment, sale_date""",

    "winsorize_iqr": with_(SALES, SCOPED, DAILY, WINSOR, PREPARED) + "select * from prepared",

    "moving_average": with_(SALES, SCOPED, DAILY, WINSOR) + """
select store, segment, ds, y_raw,
       greatest(avg(y) over (partition by store, segment order by ds
                rows between 3 preceding and 3 following), 0) as y
from clipped""",

    "ema": with_(SALES, SCOPED, DAILY) + EMA_7,
    "savgol": with_(SALES, SCOPED, DAILY) + SAVGOL_7,

    "daily_average": with_(SALES, SCOPED, DAILY) + """
select store, segment, avg(y) as avg_daily_qty from daily group by store, segment""",

    "segment_volatility": with_(SALES, SCOPED, DAILY) + """
select store, segment,
       case when sum(lines) < 2 or avg(y) = 0 then 0.3
            when stddev_samp(y) is not null then least(greatest(stddev_samp(y) / avg(y), 0), 1) end as volatility,
       case when avg(y) > 0 then stddev_samp(y) / avg(y) else 0 end as cv_raw
from daily group by store, segment""",

    "series_stats": with_(SALES, SCOPED, DAILY, WINSOR) + """,
ma as (select store, segment, ds, y_raw,
       greatest(avg(y) over (partition by store, segment order by ds
                rows between 3 preceding and 3 following), 0) as y from clipped),
s as (select store, segment, avg(y_raw) as mean_before, stddev_samp(y_raw) as std_before,
             avg(y) as mean_after, stddev_samp(y) as std_after from ma group by store, segment)
select *, mean_after - mean_before as mean_diff, std_after - std_before as std_diff,
       cv_after_pct - cv_before_pct as cv_diff_pct
from (select *, case when mean_before > 0 then std_before / mean_before * 100 else 0 end as cv_before_pct,
                case when mean_after > 0 then std_after / mean_after * 100 else 0 end as cv_after_pct
      from s)""".replace("with ", "with ", 1),

    "history_stats": with_(SALES, SCOPED, DAILY, WINSOR, PREPARED) + """,
raw as (select store, segment, min(ds) as first_date, max(ds) as last_date,
               sum(y) as total_qty, sum(amount) as total_amount from daily group by store, segment),
proc as (select store, segment, avg(y) as avg_daily, max(y) as max_daily, min(y) as min_daily
         from prepared group by store, segment)
select r.store, r.segment, first_date, last_date, cast(date_diff('day', first_date, last_date) + 1 as integer) as span_days,
       total_qty, cast(total_amount as double) as total_amount,
       case when total_qty > 0 then cast(total_amount as double) / total_qty else 0 end as avg_price,
       avg_daily, max_daily, min_daily
from raw r join proc p on r.store = p.store and r.segment = p.segment""",

    "last_30_days": with_(SALES, SCOPED, DAILY) + """
select store, segment, sum(y) as qty_last_30_days from (
  select *, max(ds) over (partition by store, segment) as last from daily)
where ds >= last - interval 30 day group by store, segment""",

    "last_n_observations": with_(SALES, SCOPED, DAILY, WINSOR, PREPARED) + """
select store, segment, avg(y) as last30_mean, sum(y) as last30_sum from (
  select *, row_number() over (partition by store, segment order by ds desc) as rk from prepared)
where rk <= 30 group by store, segment""",
}


MONTHLY = """msum as (
  select store, segment, date_trunc('month', sale_date) as month, cast(sum(qty) as double) as qty,
         cast(coalesce(sum(amount), 0) as double) as amount,
         count(distinct article) as unique_products
  from scoped group by store, segment, date_trunc('month', sale_date)),
monthly as (
  select store, segment, cast(month as date) as month, qty, amount, unique_products,
         case when qty > 0 then amount / qty else 0 end as avg_price,
         case when unique_products <> 0 then qty / unique_products end as intensity,
         (qty - lag(qty) over w) / nullif(lag(qty) over w, 0) * 100 as mom_qty_pct,
         (amount - lag(amount) over w) / nullif(lag(amount) over w, 0) * 100 as mom_amount_pct
  from msum window w as (partition by store, segment order by month))"""

WEEKDAYS = """wd as (
  select store, segment, cast(isodow(ds) - 1 as integer) as weekday, dayname(min(ds)) as weekday_name,
         sum(y) as qty, cast(sum(amount) as double) as amount
  from daily group by store, segment, isodow(ds)),
weekdays as (
  select store, segment, weekday, weekday_name, qty, amount,
         case when qty <> 0 then amount / qty end as avg_price,
         qty / nullif(sum(qty) over (partition by store, segment), 0) * 100 as qty_pct
  from wd)"""

ORACLE.update({
    "monthly_sales": with_(SALES, SCOPED, MONTHLY) + "select * from monthly",

    "monthly_summary": with_(SALES, SCOPED, MONTHLY) + """,
r as (select *, row_number() over (partition by store, segment order by month) as a,
             row_number() over (partition by store, segment order by month desc) as d from monthly),
s as (select store, segment, count(*) as months, avg(qty) as mean_qty, avg(amount) as mean_amount,
             max(qty) filter (where d = 1) as last_qty, max(qty) filter (where d = 2) as prev_qty,
             max(amount) filter (where d = 1) as last_amount,
             max(unique_products) filter (where d = 1) as last_products,
             avg(unique_products) as mean_products,
             max(avg_price) filter (where d = 1) as last_price,
             avg(avg_price) as mean_price, stddev_samp(avg_price) as std_price,
             avg(avg_price) filter (where d <= 3) as recent_price,
             avg(avg_price) filter (where a <= 3) as early_price
      from r group by store, segment)
select store, segment, months, mean_qty, mean_amount, last_qty, prev_qty, last_amount,
       last_qty - mean_qty as last_vs_mean_qty, last_amount - mean_amount as last_vs_mean_amount,
       case when months >= 2 then (last_qty / nullif(prev_qty, 0) - 1) * 100 end as mom_growth_pct,
       last_products, mean_products, last_price, mean_price, std_price,
       std_price < mean_price * 0.2 as price_stable,
       case when months >= 3 then recent_price end as recent_price,
       case when months >= 3 then early_price end as early_price,
       mean_qty * 1.2 as stock_target_month, mean_amount * 1.1 as revenue_target_month
from s""",

    "monthly_seasonality": with_(SALES, SCOPED, MONTHLY) + """
select store, segment, months, seasonality_std, seasonality_std > mean_qty * 0.3 as high_seasonality
from (select store, segment, count(*) as months, avg(qty) as mean_qty from monthly group by store, segment) t
join (select store, segment, stddev_samp(mq) as seasonality_std
      from (select store, segment, month(month) as mn, avg(qty) as mq from monthly group by store, segment, month(month))
      group by store, segment) u using (store, segment)
where months >= 6""",

    "recent_months": with_(SALES, SCOPED, MONTHLY) + """
select store, segment, month, qty, amount, unique_products, avg_price, intensity, mom_qty_pct, mom_amount_pct
from (select *, row_number() over (partition by store, segment order by month desc) as rk from monthly)
where rk <= 6""",

    "weekday_sales": with_(SALES, SCOPED, DAILY, WEEKDAYS) + "select * from weekdays",

    "weekday_extremes": with_(SALES, SCOPED, DAILY, WEEKDAYS) + """
select store, segment,
       (array_agg(weekday order by qty desc, weekday))[1] as best_weekday,
       (array_agg(weekday order by qty, weekday))[1] as worst_weekday,
       (array_agg(weekday order by amount desc, weekday))[1] as best_weekday_amount,
       stddev_samp(qty) as weekday_std, min(qty) as weekday_min, avg(qty) as weekday_mean,
       min(qty) < avg(qty) * 0.7 as weak_day_gap,
       (array_agg(weekday order by qty desc, weekday))[1] in (5, 6) as peak_on_weekend
from weekdays group by store, segment""",

    "weekday_strength": with_(SALES, SCOPED, DAILY, WEEKDAYS) + """
select store, segment, weekday, qty,
       case when qty < avg(qty) over (partition by store, segment) * 0.8 then 'weak'
            when qty > avg(qty) over (partition by store, segment) * 1.2 then 'strong'
            else 'normal' end as strength
from weekdays""",

    "week_weekday_matrix": with_(SALES, SCOPED, DAILY) + """
select store, segment, cast(weekofyear(ds) as integer) as iso_week,
       coalesce(sum(y) filter (where isodow(ds) = 1), 0) as mon,
       coalesce(sum(y) filter (where isodow(ds) = 2), 0) as tue,
       coalesce(sum(y) filter (where isodow(ds) = 3), 0) as wed,
       coalesce(sum(y) filter (where isodow(ds) = 4), 0) as thu,
       coalesce(sum(y) filter (where isodow(ds) = 5), 0) as fri,
       coalesce(sum(y) filter (where isodow(ds) = 6), 0) as sat,
       coalesce(sum(y) filter (where isodow(ds) = 7), 0) as sun
from daily group by store, segment, weekofyear(ds)""",
})


TREND = """bounds as (select store, segment, min(sale_date) as first_date, max(sale_date) as last_date
                 from scoped group by store, segment),
trend0 as (
  select s.store, s.segment, model, cast(sum(qty) as double) as total_qty,
         cast(coalesce(sum(amount), 0) as double) as total_revenue,
         cast(coalesce(sum(qty) filter (where date_diff('day', first_date, sale_date) * 2 < date_diff('day', first_date, last_date)), 0) as double) as period1_qty,
         cast(coalesce(sum(qty) filter (where date_diff('day', first_date, sale_date) * 2 >= date_diff('day', first_date, last_date)), 0) as double) as period2_qty,
         min(sale_date) as first_sale, max(sale_date) as last_sale
  from scoped s join bounds b on s.store = b.store and s.segment = b.segment
  where model is not null group by s.store, s.segment, model),
trend as (
  select *, case when period1_qty > 0 then (period2_qty - period1_qty) / period1_qty * 100 else 0 end as change_pct
  from trend0)"""

ABC = """abc as (
  select store, segment, model, total_qty, total_revenue,
         cast(sum(cast(total_revenue as decimal(38,6))) over (partition by store, segment order by total_revenue desc, model
                                  rows between unbounded preceding and current row) as double) as cumulative_revenue,
         cast(sum(cast(total_revenue as decimal(38,6))) over (partition by store, segment order by total_revenue desc, model
                                  rows between unbounded preceding and current row) as double)
           / nullif(cast(sum(cast(total_revenue as decimal(38,6))) over (partition by store, segment) as double), 0) * 100 as cumulative_pct
  from trend),
abcc as (select *, case when cumulative_pct <= 80 then 'A' when cumulative_pct <= 95 then 'B' else 'C' end as abc_class
         from abc)"""

ORACLE.update({
    "product_trend": with_(SALES, SCOPED, TREND) + """
select *, 100 - least(abs(change_pct), 100) as stability, cast(date_diff('day', first_sale, last_sale) as integer) as days_active
from trend""",

    "align_periods": with_(SALES, SCOPED, TREND) + """
select store, segment, model, total_qty, period1_qty, period2_qty from trend""",

    "abc_classify": with_(SALES, SCOPED, TREND, ABC) + "select * from abcc",

    "abc_summary": with_(SALES, SCOPED, TREND, ABC) + """
select store, segment, abc_class,
       case abc_class when 'A' then '80% of revenue' when 'B' then '15% of revenue' else '5% of revenue' end as abc_label,
       count(*) as products, sum(total_revenue) as revenue,
       round_even(sum(total_revenue) / nullif(sum(sum(total_revenue)) over (partition by store, segment), 0) * 100, 2)
         as revenue_share_pct
from abcc group by store, segment, abc_class""",

    "top_class_a": with_(SALES, SCOPED, TREND, ABC) + """,
tot as (select store, segment, cast(coalesce(sum(amount), 0) as double) as sa from scoped group by store, segment)
select a.store, a.segment, rank, model, total_qty, total_revenue,
       round_even(total_revenue / nullif(sa, 0) * 100, 2) as revenue_share_pct
from (select *, cast(row_number() over (partition by store, segment order by total_revenue desc, model) as integer) as rank
      from abcc where abc_class = 'A') a
join tot t on a.store = t.store and a.segment = t.segment where rank <= 10""",

    "top_by_revenue": with_(SALES, SCOPED, TREND) + """
select store, segment, rank, model, total_qty, total_revenue, change_pct,
       100 - least(abs(change_pct), 100) as stability,
       case when total_qty <> 0 then total_revenue / total_qty end as avg_price
from (select *, cast(row_number() over (partition by store, segment order by total_revenue desc, model) as integer) as rank
      from trend) where rank <= 20""",

    "top_stable": with_(SALES, SCOPED, TREND) + """
select store, segment, rank, model, total_qty, total_revenue,
       case when total_qty <> 0 then total_revenue / total_qty end as avg_price, change_pct, stability
from (select *, cast(row_number() over (partition by store, segment order by stability desc, model) as integer) as rank
      from (select *, 100 - least(abs(change_pct), 100) as stability from trend
            where period1_qty > 0 and period2_qty > 0)) where rank <= 20""",

    "top_declining": with_(SALES, SCOPED, TREND) + """
select store, segment, rank, model, total_qty, period1_qty, period2_qty, change_pct, change_pct < -50 as critical
from (select *, cast(row_number() over (partition by store, segment order by change_pct, model) as integer) as rank
      from trend where change_pct < 0) where rank <= 20""",

    "product_kpis": with_(SALES, SCOPED, TREND) + """
select store, segment, count(*) as models,
       count(*) filter (where change_pct > 20) as growing_count,
       count(*) filter (where change_pct < -20) as declining_count,
       count(*) filter (where change_pct between -20 and 20) as stable_count,
       cast(sum(cast(total_revenue as decimal(38,6))) filter (where rk <= 5) as double)
         / nullif(cast(sum(cast(total_revenue as decimal(38,6))) as double), 0) * 100 as top5_share_pct,
       cast(sum(cast(total_revenue as decimal(38,6))) filter (where rk <= 10) as double)
         / nullif(cast(sum(cast(total_revenue as decimal(38,6))) as double), 0) * 100 as top10_share_pct,
       max(model) filter (where rk = 1) as leader_model,
       max(total_revenue) filter (where rk = 1) as leader_revenue,
       count(*) filter (where rk <= 20 and change_pct > 20) as top20_growing
from (select *, row_number() over (partition by store, segment order by total_revenue desc, model) as rk from trend)
group by store, segment""",

    "top_models_by_segment": with_(SALES, SCOPED) + """
select store, segment, rank, model, qty, amount, case when qty > 0 then amount / qty else 0 end as price
from (select *, cast(row_number() over (partition by store, segment order by amount desc, model) as integer) as rank
      from (select store, segment, model, cast(sum(qty) as double) as qty,
                   cast(coalesce(sum(amount), 0) as double) as amount
            from scoped where model is not null group by store, segment, model))
where rank <= 10""",

    "scope_kpis": with_(SALES, SCOPED) + """,
pd as (select store, segment, sale_date, count(distinct article) as arts, sum(qty) as q
       from scoped group by store, segment, sale_date),
pda as (select store, segment, sum(arts) as art_days, count(*) as days from pd group by store, segment),
l as (select store, segment, count(*) as lines, cast(sum(qty) as double) as total_qty,
             cast(coalesce(sum(amount), 0) as double) as total_amount,
             avg(price) as mean_line_price, cast(sum(amount) as double) / nullif(count(amount), 0) as mean_line_amount,
             min(sale_date) as f, max(sale_date) as t
      from scoped group by store, segment)
select l.store, l.segment, lines, total_qty, total_amount, total_amount / lines as avg_ticket,
       lines / (date_diff('day', f, t) + 1) as lines_per_day, mean_line_amount, mean_line_price,
       case when art_days / days > 0 then (total_qty / days) / (art_days / days) else 0 end as sell_through,
       case when total_qty > 0 then total_amount / total_qty else 0 end as weighted_price
from l join pda on l.store = pda.store and l.segment = pda.segment""",

    "dataset_overview": with_(SALES) + """
select count(*) as lines, count(distinct article) as articles, count(distinct store) as stores,
       count(distinct segment) as segments, min(sale_date) as first_date, max(sale_date) as last_date,
       cast(coalesce(sum(amount), 0) as double) as total_amount,
       (select avg(cast(q as double)) from (select sum(qty) as q from sales group by sale_date)) as avg_daily_qty
from sales""",

    "line_window_sums": with_(SALES, SCOPED) + """,
r as (select *, row_number() over (partition by store, segment
                  order by sale_date, l_orderkey, l_linenumber, l_partkey, l_suppkey) as a,
              row_number() over (partition by store, segment
                  order by sale_date desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as d
      from scoped),
g as (select store, segment, count(*) as lines,
             sum(qty) filter (where a <= 30) as hq, sum(qty) filter (where d <= 30) as tq,
             sum(amount) filter (where a <= 30) as ha, sum(amount) filter (where d <= 30) as ta
      from r group by store, segment)
select store, segment, lines, cast(hq as double) as first_qty, cast(tq as double) as last_qty,
       cast(coalesce(ha, 0) as double) as first_amount, cast(coalesce(ta, 0) as double) as last_amount,
       case when hq > 0 then cast(ha as double) / cast(hq as double) else 0 end as first_price,
       case when tq > 0 then cast(ta as double) / cast(tq as double) else 0 end as last_price
from g""",
})


ELASTIC = """edges as (
  select model, count(*) as model_lines, quantile_cont(price, [0, 1/3, 2/3, 1]) as q,
         quantile_cont(price, 0.5) as med
  from sales where model is not null and price is not null group by model),
pick as (
  select *, case when model_lines < 10 then null
                 when q[1] < q[2] and q[2] < q[3] and q[3] < q[4] then 3
                 when q[1] < med and med < q[4] then 2 end as bins
  from edges),
binned as (
  select s.model, s.price, s.qty, s.amount, p.bins,
         case when p.bins = 3 then q[2] else med end as edge_low,
         case when p.bins = 3 then q[3] else med end as edge_high
  from sales s join pick p on s.model = p.model where p.bins is not null),
lab as (select *, case when price <= edge_low then 'low' when price > edge_high then 'high' else 'mid' end as price_bin
        from binned),
g as (
  select model, any_value(bins) as bins, count(*) as lines, avg(price) as avg_price,
         cast(coalesce(sum(amount), 0) as double) as total_revenue, cast(sum(qty) as double) as total_qty,
         avg(price) filter (where price_bin = 'low') as low_price,
         avg(price) filter (where price_bin = 'high') as high_price,
         cast(coalesce(sum(qty) filter (where price_bin = 'low'), 0) as double) as low_qty,
         cast(coalesce(sum(qty) filter (where price_bin = 'high'), 0) as double) as high_qty
  from lab group by model),
el as (
  select *, (high_price - low_price) / low_price * 100 as price_change_pct,
         (high_qty - low_qty) / nullif(low_qty, 0) * 100 as qty_change_pct
  from g where high_price <> low_price),
elc as (
  select *, qty_change_pct / nullif(price_change_pct, 0) as elasticity,
         case when qty_change_pct is null then 'undefined'
              when abs(qty_change_pct / price_change_pct) > 1 then 'elastic'
              when abs(qty_change_pct / price_change_pct) < 1 then 'inelastic'
              else 'unit' end as elasticity_class
  from el)"""

ORACLE.update({
    "price_bins": with_(SALES, ELASTIC) + """
select model, bins, edge_low, edge_high, count(*) as lines,
       count(*) filter (where price_bin = 'low') as low_lines,
       count(*) filter (where price_bin = 'mid') as mid_lines,
       count(*) filter (where price_bin = 'high') as high_lines
from lab group by model, bins, edge_low, edge_high""",

    "price_elasticity": with_(SALES, ELASTIC) + "select * from elc",

    "elasticity_summary": with_(SALES, ELASTIC) + """
select *, case when elastic_revenue + inelastic_revenue > 0
               then elastic_revenue / (elastic_revenue + inelastic_revenue) * 100 else 0 end as elastic_share_pct,
          case when elastic_revenue + inelastic_revenue > 0
               then inelastic_revenue / (elastic_revenue + inelastic_revenue) * 100 else 0 end as inelastic_share_pct
from (select count(*) as analysed,
             count(*) filter (where elasticity_class = 'elastic') as elastic_count,
             count(*) filter (where elasticity_class = 'inelastic') as inelastic_count,
             count(*) filter (where elasticity_class = 'unit') as unit_count,
             count(*) filter (where elasticity_class = 'undefined') as undefined_count,
             coalesce(cast(sum(cast(total_revenue as decimal(38,6))) filter (where elasticity_class = 'elastic') as double), 0) as elastic_revenue,
             coalesce(cast(sum(cast(total_revenue as decimal(38,6))) filter (where elasticity_class = 'inelastic') as double), 0) as inelastic_revenue
      from elc)""",

    "top_elasticity": with_(SALES, ELASTIC) + """
select * from elc order by total_revenue desc, model limit 20""",
})


FIT = """guard as (select store, segment from scoped group by store, segment having count(*) >= 10),
ser as (select p.store, p.segment, p.ds, p.y from prepared p
        join guard g on p.store = g.store and p.segment = g.segment),
f1 as (select *, min(ds) over w as first_ds, max(ds) over w as last_ds,
              cast(date_diff('day', min(ds) over w, ds) as double) as t, avg(y) over w as mean_y
       from ser window w as (partition by store, segment)),
f2 as (select *, coalesce(regr_slope(y, t) over w, 0) as slope,
              coalesce(regr_intercept(y, t) over w, mean_y) as intercept
       from f1 window w as (partition by store, segment)),
f3 as (select *, intercept + slope * t as trend, cast(isodow(ds) - 1 as integer) as weekday,
              month(ds) as month_num from f2),
f4 as (select *, y / nullif(greatest(trend, 0.05 * mean_y), 0) as ratio from f3),
f5 as (select *, avg(ratio) over (partition by store, segment, weekday) as wi from f4),
f6 as (select *, avg(ratio / nullif(wi, 0)) over (partition by store, segment, month_num) as mi from f5),
f7 as (select *, trend * coalesce(wi, 1) * coalesce(mi, 1) as yhat_raw from f6),
fitted as (select *, coalesce(stddev_samp(y - yhat_raw) over (partition by store, segment), 0) as resid_sd from f7),
coef as (select store, segment, any_value(first_ds) as first_ds, any_value(last_ds) as last_ds,
                count(*) as n_days, any_value(mean_y) as mean_y, any_value(slope) as slope,
                any_value(intercept) as intercept, any_value(resid_sd) as resid_sd
         from fitted group by store, segment),
wix as (select store, segment, weekday, any_value(wi) as wi from fitted group by store, segment, weekday),
mix as (select store, segment, month_num, any_value(mi) as mi from fitted group by store, segment, month_num),
fut as (select c.store, c.segment, cast(c.last_ds + cast(r.i as integer) as date) as ds,
               c.first_ds, c.slope, c.intercept, c.resid_sd
        from coef c cross join range(1, 31) r(i)),
futp as (select f.store, f.segment, f.ds, f.intercept + f.slope * date_diff('day', f.first_ds, f.ds) as trend,
                (f.intercept + f.slope * date_diff('day', f.first_ds, f.ds)) * coalesce(w.wi, 1) * coalesce(m.mi, 1) as yhat_raw,
                f.resid_sd
         from fut f
         left join wix w on f.store = w.store and f.segment = w.segment and w.weekday = isodow(f.ds) - 1
         left join mix m on f.store = m.store and f.segment = m.segment and m.month_num = month(f.ds)),
fc0 as (select store, segment, ds, false as is_future, y, trend, yhat_raw, resid_sd from fitted
        union all select store, segment, ds, true, cast(null as double), trend, yhat_raw, resid_sd from futp),
fc as (select store, segment, ds, is_future, y, trend, yhat_raw, greatest(yhat_raw, 0) as yhat,
              greatest(yhat_raw - 1.2815515655446004 * resid_sd, 0) as yhat_lower,
              greatest(yhat_raw + 1.2815515655446004 * resid_sd, 0) as yhat_upper from fc0),
scen as (select store, segment, ds, strftime(ds, '%Y-%m-%d (%A)') as date_label,
                cast(round_even(yhat_lower, 0) as bigint) as pessimistic,
                cast(round_even(yhat, 0) as bigint) as realistic,
                cast(round_even(yhat_upper, 0) as bigint) as optimistic,
                cast(round_even(trend, 0) as bigint) as trend
         from fc where is_future)"""

FC_BASE = (SALES, SCOPED, DAILY, WINSOR, PREPARED, FIT)

ORACLE.update({
    "forecast_seasonal_index": with_(*FC_BASE) + "select * from fc",
    "seasonal_coefficients": with_(*FC_BASE) + "select * from coef",
    "future_frame": with_(*FC_BASE) + "select store, segment, ds from fut",
    "future_rows": with_(*FC_BASE) + "select * from fc where is_future",
    "actual_vs_fitted": with_(*FC_BASE) + "select store, segment, ds, y, yhat_raw from fc where not is_future",

    "forecast_accuracy": with_(*FC_BASE) + """
select store, segment, n_days, mae, rmse, mape, r2,
       case when mape < 10 and r2 > 0.8 then 'excellent' when mape < 20 and r2 > 0.6 then 'good'
            else 'fair' end as quality
from (select store, segment, count(*) as n_days, avg(abs(y - yhat_raw)) as mae,
             sqrt(avg((y - yhat_raw) * (y - yhat_raw))) as rmse,
             coalesce(avg(abs((y - yhat_raw) / y)) filter (where y <> 0) * 100, 0) as mape,
             case when sum((y - m) * (y - m)) > 0 then 1 - sum((y - yhat_raw) * (y - yhat_raw)) / sum((y - m) * (y - m))
                  when sum((y - yhat_raw) * (y - yhat_raw)) = 0 then 1 else 0 end as r2
      from (select *, avg(y) over (partition by store, segment) as m from fc where not is_future)
      group by store, segment)""",

    "forecast_scenarios": with_(*FC_BASE) + "select * from scen",

    "first_forecast_days": with_(*FC_BASE) + """
select store, segment, day, ds, yhat, yhat_lower, yhat_upper
from (select *, cast(row_number() over (partition by store, segment order by ds) as integer) as day from fc where is_future)
where day <= 10""",

    "forecast_kpis": with_(*FC_BASE) + """,
sa as (select store, segment, avg(realistic) as r, avg(optimistic) as o, avg(pessimistic) as p,
              avg(realistic) filter (where d <= 7) - avg(realistic) filter (where a <= 7) as horizon_trend
       from (select *, row_number() over (partition by store, segment order by ds) as a,
                    row_number() over (partition by store, segment order by ds desc) as d from scen)
       group by store, segment),
ft as (select store, segment, avg(yhat) as avg_forecast, sum(yhat) as total_forecast from fc where is_future
       group by store, segment),
rc as (select store, segment, avg(y) filter (where rk <= 30) as last30_mean, sum(y) filter (where rk <= 30) as last_h_sum
       from (select *, row_number() over (partition by store, segment order by ds desc) as rk from ser)
       group by store, segment),
pr as (select store, segment, case when sum(y) > 0 then cast(sum(amount) as double) / sum(y) else 0 end as weighted_price,
              case when sum(lines) < 2 or avg(y) = 0 then 0.3
                   when stddev_samp(y) is not null then least(greatest(stddev_samp(y) / avg(y), 0), 1) end as volatility
       from daily group by store, segment)
select ft.store, ft.segment, avg_forecast, total_forecast,
       case when weighted_price > 0 then total_forecast * weighted_price else 0 end as forecast_revenue,
       avg_forecast - last30_mean as avg_vs_last30, total_forecast - last_h_sum as total_vs_last_h,
       case when last_h_sum > 0 then (total_forecast / last_h_sum - 1) * 100 else 0 end as forecast_growth_pct,
       (1 - volatility) * 100 as confidence_score,
       case when r > 0 then ((o - p) / 2) / r * 100 else 0 end as uncertainty_pct,
       horizon_trend,
       case when horizon_trend > 0 then 'up' when horizon_trend < 0 then 'down' else 'flat' end as trend_direction,
       total_forecast * 1.2 as stock_target, total_forecast * 1.2 / 30 as stock_per_day,
       cast(floor(total_forecast * 1.2 / 240) as bigint) as transactions_per_hour
from ft join sa using (store, segment) join rc using (store, segment) join pr using (store, segment)""",
})

FMONTH = """fm as (select store, segment, cast(date_trunc('month', ds) as date) as month, sum(yhat_raw) as forecast_qty
       from futp group by all),
la as (select store, segment, arg_max(qty, month) as last_actual_qty, arg_max(avg_price, month) as last_actual_price
       from monthly group by store, segment),
fmon as (select fm.store, fm.segment, month, forecast_qty, forecast_qty * last_actual_price as forecast_revenue,
                last_actual_qty, (forecast_qty / nullif(last_actual_qty, 0) - 1) * 100 as growth_vs_last_pct,
                month = min(month) over (partition by fm.store, fm.segment) as is_first,
                month = max(month) over (partition by fm.store, fm.segment) as is_last
         from fm join la on fm.store = la.store and fm.segment = la.segment)"""

ORACLE.update({
    "forecast_monthly": with_(*FC_BASE, MONTHLY, FMONTH) + "select * from fmon",
    "actual_vs_forecast": with_(*FC_BASE, MONTHLY, FMONTH) + """
select store, segment, month, qty, 'actual' as kind
from (select *, row_number() over (partition by store, segment order by month desc) as rk from monthly) where rk <= 6
union all select store, segment, month, forecast_qty as qty, 'forecast' as kind from fmon""",
})


def _solved(gram: str, rhs: str, penalty: str) -> str:
    """SQL list of unknowns of ``(gram + diag(penalty)) x = rhs``, by Gauss-Jordan steps on the extended rows."""
    return f"""list_transform(list_reduce(
  list_concat([list_transform({gram}, lambda r, i:
                 list_append(list_transform(r, lambda v, j: v + case when i = j then {penalty}[i] else 0 end), {rhs}[i]))],
              list_transform(range(1, len({rhs}) + 1), lambda k: [[cast(k as double)]])),
  lambda m, step: list_transform(m, lambda r, i:
    case when i = cast(step[1][1] as bigint)
         then list_transform(r, lambda v: v / r[i])
         else list_transform(r, lambda v, j: v - r[cast(step[1][1] as bigint)] * m[cast(step[1][1] as bigint)][j]
                                                 / m[cast(step[1][1] as bigint)][cast(step[1][1] as bigint)]) end)),
  lambda r: r[-1])"""


def _fourier_sql() -> str:
    """25 knots, orders 3 and 10, eight alternating rounds; every ridge step from its normal equations."""
    wave = [(f, p, k) for p, order in ((7.0, 3), (365.25, 10)) for f in ("sin", "cos") for k in range(1, order + 1)]
    season = ", ".join(f"{f}(2 * pi() * d * {k} / {p}::double)" for f, p, k in wave)
    ctes = [SALES, SCOPED, DAILY, WINSOR, PREPARED, """guard as (
  select store, segment from scoped group by store, segment having count(*) >= 10),
ser as (select p.store, p.segment, p.ds, p.y from prepared p
        join guard g on p.store = g.store and p.segment = g.segment),
hist as (select store, segment, list(ds order by ds) as ds, list(y order by ds) as y, count(*) as n,
                min(ds) as f, max(ds) as t, coalesce(nullif(max(abs(y)), 0), 1) as scale
         from ser group by store, segment),
timed as (select *, list_transform(y, lambda v: v / scale) as ys,
                 list_concat(list_transform(ds, lambda v: cast(date_diff('day', f, v) as double)),
                             list_transform(range(1, 31), lambda h: cast(date_diff('day', f, t) + h as double))) as days,
                 greatest(date_diff('day', f, t), 1)::double as span,
                 greatest(n * 4 // 5, 1) as cut from hist),
knots as (select *, list_filter(list_transform(
                      list_sort(list_distinct(list_transform(range(0, 26), lambda k: k * (cut - 1) // 25)))[2:],
                      lambda i: days[i + 1] / span), lambda k: k > 0 and k < 1) as kn from timed),
feat as materialized (
  select store, segment, ds, y, n, t, scale, ys,
         list_transform(days, lambda d: list_concat([1, d / span], list_transform(kn, lambda k: greatest(d / span - k, 0)))) as trows,
         list_transform(days, lambda d: [""" + season + """]) as srows,
         list_concat([1e-8, 1e-8], list_transform(kn, lambda k: 0.4::double)) as tpen,
         list_transform(range(26), lambda k: 0.011::double) as spen
  from knots),
r0 as materialized (select store, segment, list_transform(range(26), lambda k: 0::double) as beta from feat)"""]
    for r in range(1, 9):
        ctes.append(f"""a{r} as materialized (
  select f.*, list_transform(srows, lambda s: 1 + list_dot_product(s, beta)) as mult
  from feat f join (select store, segment, beta from r{r - 1}) r using (store, segment)),
b{r} as materialized (
  select *, list_transform(range(1, len(tpen) + 1), lambda c: list_transform(range(1, n + 1), lambda i: trows[i][c] * mult[i])) as x
  from a{r}),
c{r} as materialized (
  select *, list_transform(x, lambda p: list_transform(x, lambda q: list_dot_product(p, q))) as gram,
         list_transform(x, lambda p: list_dot_product(p, ys)) as rhs from b{r}),
d{r} as materialized (select * exclude (x, gram, rhs, mult), {_solved('gram', 'rhs', 'tpen')} as gamma from c{r}),
e{r} as materialized (select *, list_transform(trows, lambda s: list_dot_product(s, gamma)) as g from d{r}),
h{r} as materialized (
  select *, list_transform(range(1, 27), lambda c: list_transform(range(1, n + 1), lambda i: srows[i][c] * g[i])) as x,
         list_transform(ys, lambda v, i: v - g[i]) as rest from e{r}),
k{r} as materialized (
  select *, list_transform(x, lambda p: list_transform(x, lambda q: list_dot_product(p, q))) as gram,
         list_transform(x, lambda p: list_dot_product(p, rest)) as rhs from h{r}),
r{r} as materialized (select * exclude (x, gram, rhs, rest), {_solved('gram', 'rhs', 'spen')} as beta from k{r})""")
    return with_(*ctes) + """,
fitted as (select *, list_transform(srows, lambda s, i: g[i] * (1 + list_dot_product(s, beta))) as raw from r8),
spread as (select *, coalesce(list_stddev_samp(list_transform(ys, lambda v, i: v - raw[i])), 0) as sd from fitted),
days as (select store, segment, n, t, scale, sd, unnest(list_concat(ds, list_transform(range(1, 31), lambda h: cast(t + cast(h as integer) as date)))) as ds,
                unnest(list_concat(y, list_transform(range(30), lambda h: null::double))) as y,
                unnest(g) as trend, unnest(raw) as raw from spread)
select store, segment, ds, ds > t as is_future, y, trend * scale as trend, raw * scale as yhat_raw,
       greatest(raw * scale, 0) as yhat,
       greatest((raw - 1.2815515655446004 * sd) * scale, 0) as yhat_lower,
       greatest((raw + 1.2815515655446004 * sd) * scale, 0) as yhat_upper
from days"""


ORACLE["forecast_fourier"] = _fourier_sql()


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


# Findings by hand: family, code, severity, value, condition over the indicator row.
FINDINGS = (
    ("K1", "monthly_drop_critical", "critical", "mom_growth_pct", "months > 1 and last_month_qty / 0.8 < prev_month_qty"),
    ("K1", "monthly_drop_warning", "warning", "mom_growth_pct", "months > 1 and last_month_qty < prev_month_qty * 0.9 and not last_month_qty < prev_month_qty * 0.8"),
    ("K2", "price_rise", "warning", "recent_price / early_price", "months > 2 and recent_price > early_price * 1.15"),
    ("K3", "assortment_cut", "warning", "last_products", "months > 1 and last_products < mean_products * 0.7"),
    ("K4", "forecast_up", "info", "first_month_ratio", "first_month_ratio > 1.3"),
    ("K4", "forecast_down", "warning", "first_month_ratio", "first_month_ratio < 0.8"),
    ("K5", "high_seasonality", "info", "seasonality_std", "high_seasonality"),
    ("K6", "sales_growing", "info", "head_tail_last_qty", "head_tail_last_qty > head_tail_first_qty * 1.2"),
    ("K6", "sales_declining", "warning", "head_tail_last_qty", "head_tail_last_qty < head_tail_first_qty * 0.8 and not head_tail_last_qty > head_tail_first_qty * 1.2"),
    ("K6", "daily_volatility_high", "warning", "raw_cv", "raw_cv > 0.5"),
    ("K6", "forecast_above_recent", "info", "avg_forecast_tail", "avg_forecast_tail > raw_last30_mean * 1.1"),
    ("K6", "forecast_below_recent", "info", "avg_forecast_tail", "avg_forecast_tail < raw_last30_mean * 0.9 and not avg_forecast_tail > raw_last30_mean * 1.1"),
    ("K7", "model_quality_excellent", "info", "mape", "mape < 10 and r2 > 0.8"),
    ("K7", "model_quality_good", "info", "mape", "mape < 20 and r2 > 0.6 and not (mape < 10 and r2 > 0.8)"),
    ("K7", "model_quality_fair", "warning", "mape", "not (mape < 20 and r2 > 0.6)"),
    ("K8", "positive_trend", "success", "forecast_growth_pct", "forecast_growth_pct > 10"),
    ("K8", "negative_trend", "error", "forecast_growth_pct", "forecast_growth_pct < -10"),
    ("K8", "stable_trend", "info", "forecast_growth_pct", "abs(forecast_growth_pct) <= 10"),
    ("K8", "low_volatility", "success", "processed_cv", "processed_cv < 0.2"),
    ("K8", "high_volatility", "warning", "processed_cv", "processed_cv > 0.5"),
    ("K8", "high_accuracy", "success", "mape", "mape < 15"),
    ("K8", "moderate_accuracy", "warning", "mape", "mape > 25"),
    ("K8", "uneven_weekdays", "info", "weekday_std", "weekday_std > raw_daily_mean * 0.3"),
    ("K9", "prices_rising", "info", "head_tail_last_price", "lines > 29 and head_tail_last_price > head_tail_first_price * 1.1"),
    ("K9", "prices_falling", "info", "head_tail_last_price", "lines > 29 and head_tail_last_price < head_tail_first_price * 0.9 and not head_tail_last_price > head_tail_first_price * 1.1"),
    ("K9", "prices_stable", "info", "head_tail_last_price", "lines > 29 and not head_tail_last_price > head_tail_first_price * 1.1 and not head_tail_last_price < head_tail_first_price * 0.9"),
    ("K10", "weekend_peak", "info", "best_weekday", "best_weekday >= 5"),
    ("K10", "weekday_peak", "info", "best_weekday", "best_weekday < 5"),
    ("K10", "weak_days_promo", "info", "weekday_min", "weak_day_gap"),
    ("K10", "promo_campaign", "warning", "forecast_growth_pct", "forecast_growth_pct < 0"),
    ("K10", "just_in_time", "info", "processed_cv", "processed_cv < 0.3"),
    ("K10", "buffer_stock", "info", "processed_cv", "processed_cv >= 0.3"),
    ("K11", "priority_scale", "success", "forecast_growth_pct", "forecast_growth_pct > 15"),
    ("K11", "priority_crisis", "error", "forecast_growth_pct", "forecast_growth_pct < -15"),
    ("K11", "priority_stabilise", "warning", "processed_cv", "abs(forecast_growth_pct) <= 15 and processed_cv > 0.5"),
    ("K11", "priority_optimise", "info", "forecast_growth_pct", "abs(forecast_growth_pct) <= 15 and processed_cv <= 0.5"),
    ("K12", "concentration_risk", "warning", "top5_share_pct", "top5_share_pct > 50"),
    ("K12", "balanced_portfolio", "success", "top5_share_pct", "not top5_share_pct > 50"),
    ("K12", "top10_concentration_risk", "warning", "top10_share_pct", "top10_share_pct > 70"),
    ("K12", "top10_normal", "success", "top10_share_pct", "not top10_share_pct > 70"),
    ("K12", "many_growing", "success", "growing_count", "growing_count > 10"),
    ("K12", "few_growing", "warning", "growing_count", "not growing_count > 10"),
    ("K12", "declining_critical", "critical", "declining_count", "declining_count > 10"),
    ("K12", "declining_attention", "warning", "declining_count", "declining_count > 0 and not declining_count > 10"),
    ("K12", "declining_none", "success", "declining_count", "not declining_count > 0"),
    ("K12", "many_stable", "success", "stable_count", "stable_count > 20"),
    ("K12", "few_stable", "warning", "stable_count", "not stable_count > 20"),
    ("K12", "low_ticket", "info", "avg_ticket", "avg_ticket < mean_line_amount * 0.8"),
    ("K12", "ticket_normal", "success", "avg_ticket", "not avg_ticket < mean_line_amount * 0.8"),
    ("K13", "confidence_excellent", "success", "confidence_score", "confidence_score >= 80"),
    ("K13", "confidence_good", "warning", "confidence_score", "confidence_score >= 60 and not confidence_score >= 80"),
    ("K13", "confidence_improve", "error", "confidence_score", "not confidence_score >= 60"),
    ("K14", "short_history", "info", "data_days", "data_days < 90"),
    ("K14", "seasonal_data", "info", "lines", "lines > 365"),
    ("K15", "horizon_short", "info", "horizon", "horizon < 15"),
    ("K15", "horizon_medium", "info", "horizon", "horizon between 15 and 30"),
    ("K15", "horizon_long", "info", "horizon", "horizon >= 31"),
    ("K15", "buffer_none", "success", "mape", "mape < 10"),
    ("K15", "buffer_10_15", "info", "mape", "mape >= 10 and mape < 20"),
    ("K15", "buffer_20_30", "warning", "mape", "not mape < 20"),
    ("K15", "interval_confident", "success", "uncertainty_pct", "uncertainty_pct < 20"),
    ("K15", "interval_needs_buffer", "warning", "uncertainty_pct", "not uncertainty_pct < 20"),
)


def _rules_sql(horizon: int) -> str:
    ind = f"""with
ms as {_sub('monthly_summary')}, sea as {_sub('monthly_seasonality')}, fmo as {_sub('forecast_monthly')},
lw as {_sub('line_window_sums')}, vol as {_sub('segment_volatility')}, fk as {_sub('forecast_kpis')},
ss as (with {SALES}, {SCOPED}, {DAILY}, {WINSOR}, {PREPARED}
       select store, segment, case when avg(y) > 0 then stddev_samp(y) / avg(y) * 100 else 0 end as cv_after_pct
       from prepared group by store, segment), acc as {_sub('forecast_accuracy')}, we as {_sub('weekday_extremes')},
pk as {_sub('product_kpis')}, sk as {_sub('scope_kpis')}, hs as {_sub('history_stats')},
guard as {_sub('min_rows_guard')},
ftail as ({with_(*FC_BASE)}
       select store, segment, avg(yhat) as avg_forecast_tail
       from (select *, row_number() over (partition by store, segment order by ds desc) as d from fc where is_future)
       where d <= 30 group by store, segment),
rr as (with {SALES}, {SCOPED}, {DAILY}
       select store, segment, avg(y) as raw_daily_mean, avg(y) filter (where rk <= 30) as raw_last30_mean
       from (select *, row_number() over (partition by store, segment order by ds desc) as rk from daily)
       group by store, segment),
ind as (
  select g.store, g.segment, ms.months, ms.last_qty as last_month_qty, ms.prev_qty as prev_month_qty,
         ms.mom_growth_pct, ms.recent_price, ms.early_price, ms.last_products, ms.mean_products,
         sea.seasonality_std, sea.high_seasonality,
         fmo.forecast_qty / nullif(fmo.last_actual_qty, 0) as first_month_ratio,
         lw.lines, lw.first_qty as head_tail_first_qty, lw.last_qty as head_tail_last_qty,
         lw.first_price as head_tail_first_price, lw.last_price as head_tail_last_price,
         vol.cv_raw as raw_cv, rr.raw_daily_mean, rr.raw_last30_mean,
         ftail.avg_forecast_tail, fk.forecast_growth_pct, fk.confidence_score, fk.uncertainty_pct,
         ss.cv_after_pct / 100 as processed_cv, acc.mape, acc.r2,
         we.best_weekday, we.weekday_std, we.weekday_min, we.weak_day_gap,
         pk.top5_share_pct, pk.top10_share_pct, pk.growing_count, pk.declining_count, pk.stable_count,
         sk.avg_ticket, sk.mean_line_amount, hs.span_days - 1 as data_days, 30 as horizon
  from guard g
  left join ms using (store, segment) left join sea using (store, segment)
  left join (select * from fmo where is_first) fmo using (store, segment)
  left join lw using (store, segment) left join vol using (store, segment) left join rr using (store, segment)
  left join fk using (store, segment) left join ss using (store, segment) left join acc using (store, segment)
  left join we using (store, segment) left join pk using (store, segment) left join sk using (store, segment)
  left join hs using (store, segment) left join ftail using (store, segment))
"""
    ind = (ind.replace("range(1, 31) r(i)", f"range(1, {horizon + 1}) r(i)")
              .replace("sum(y) filter (where rk <= 30) as last_h_sum", f"sum(y) filter (where rk <= {horizon}) as last_h_sum")
              .replace("30 as horizon", f"{horizon} as horizon"))
    return ind + "\nunion all\n".join(
        f"select store, segment, '{family}' as family, '{code}' as rule_code, '{severity}' as severity, "
        f"cast({value} as double) as value from ind where {condition}"
        for family, code, severity, value, condition in FINDINGS)


ORACLE["rule_hits"] = _rules_sql(30)
ORACLE["rule_hits_h60"] = _rules_sql(60)

ORACLE["read_snapshot"] = ORACLE["load_sales"]
ORACLE["refreshed_monthly_sales"] = ORACLE["monthly_sales"]
ORACLE["snapshot_batch_and_stream"] = ORACLE["load_sales"]
# lines with an extra cell (k = 22) and lines cut after five cells (k = 23)
ORACLE["csv_line_outcomes"] = ORACLE["rejection_counts"].replace(
    "case when sale_date is null", "case when k in (22, 23) then 'bad_line' when sale_date is null")
ORACLE["read_sales_csv"] = ORACLE["load_sales"]
ORACLE["forecast_csv_export"] = ORACLE["forecast_scenarios"]
ORACLE["events_daily_sales"] = """
with ev as (
  select event_type as store, 'events' as segment, cast(ts as date) as ds, value
  from events where ts is not null and value > 0)
select store, segment, ds, cast(count(*) as double) as y, cast(sum(cast(value as decimal(28,6))) as double) as amount,
       count(*) as lines
from (select store, segment, ds, value from ev
      union all select '*', segment, ds, value from ev
      union all select store, '*', ds, value from ev
      union all select '*', '*', ds, value from ev)
group by store, segment, ds"""
