"""DuckDB SQL that gives the same result as each query, from the same given tables.

The retail tables appear as common table expressions with the derivation described in
FIXTURES.md. Integer percentages are rounded half up to hundredths in whole numbers.
"""

from __future__ import annotations

import re

_TABLES = {
    "categories": """
        select min(p_partkey) as category_id, p_type as category_name
        from part group by p_type""",
    "producers": """
        select min(p_partkey) as producer_id, p_brand as producer_name
        from part group by p_brand""",
    "parts": """
        select p_partkey as product_id, p_name as product_name,
          case when p_size <> 13 then category_id end as category_id,
          cast(cast(p_retailprice as decimal(18,2)) * cast(0.7 as decimal(2,1))
            as decimal(18,2)) as buy_price,
          cast(p_retailprice as decimal(18,2)) as sell_price,
          split_part(p_name, ' ', 1) as color,
          case when p_size = 27 then -1 else producer_id end as producer_id,
          'SKU-' || cast(p_partkey as varchar) as sku, p_type as description,
          cast(p_size as bigint) as size, p_brand,
          date '2001-07-31' - cast(p_partkey * 13 % 121 as integer) as day
        from part
        join categories on p_type = category_name
        join producers on p_brand = producer_name""",
    "products": """
        select product_id, product_name, category_id, buy_price, sell_price, color,
          producer_id, sku, description,
          case when size <= 4 then 0 when size <> 31 then size * 400 end as stock_qty,
          case when size <> 33 then size + 500 end as sold_qty,
          cast(0 as bigint) as complaint_qty,
          case when size <> 43 then day end as ordered_on
        from parts""",
    "sales_lines": """
        select md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
            cast(l_partkey as varchar), cast(l_suppkey as varchar),
            cast(cast(l_quantity as bigint) as varchar),
            cast(cast(round(l_extendedprice * 100) as bigint) as varchar),
            cast(cast(l_shipdate as date) as varchar))) as sale_id,
          case when not (l_quantity = 3 and l_linenumber = 3)
            then cast(l_shipdate as date) end as sold_on,
          cast(l_extendedprice as decimal(18,2)) as amount,
          case when l_quantity = 50 and l_linenumber >= 6 then -1 - l_partkey
            when l_partkey % 101 = 0 then l_partkey + 1 else l_partkey end as product_id,
          case when not (l_quantity = 1 and l_linenumber = 1) then r_name end as place,
          case when not (l_quantity = 2 and l_linenumber = 2)
            then cast(l_quantity as bigint) end as qty,
          cast(l_shipdate as date) as ship_day, cast(l_quantity as bigint) as units,
          l_linenumber as line, l_returnflag as return_flag, l_linestatus as status,
          l_tax as tax
        from lineitem
        join supplier on l_suppkey = s_suppkey
        join nation on s_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "sales": "select sale_id, sold_on, amount, product_id, place, qty from sales_lines",
    "returned_goods": """
        select md5('r' || sale_id) as return_id, product_id,
          case when line <> 7 then tax >= 0.04 end as defective,
          case line when 1 then 'said "no",' || chr(10) || 'and left' when 2 then '  blanks around '
            when 3 then '' when 4 then null else 'returned' end as description
        from sales_lines where return_flag = 'R'""",
    "special_days": """
        select o_orderkey as id,
          case when o_orderpriority = '1-URGENT' then 'Communion'
            else 'Promotion ' || o_orderpriority end as name,
          cast(o_orderdate as date) as starts_on,
          cast(o_orderdate as date)
            + cast(substring(o_orderpriority, 1, 1) as integer) * 3 as ends_on
        from orders""",
    "places": """
        select r_name as place, cast(r_regionkey * 10.0 as double) as lat,
          cast(r_regionkey * 20.0 as double) as lng from region
        union all select 'OCEANIA', -22.0, 140.0""",
    "raw_products": """
        select case p_size when 29 then null when 23 then '' else p_name end as product_name,
          case when p_size = 17 then 'UNKNOWN' else p_type end as category_name,
          case when p_size = 19 then '-5' when p_size = 20 then 'n/a'
            when p_brand = 'Brand#3' then '10.5' else '700' end as buy_price,
          '900' as sell_price, split_part(p_name, ' ', 1) as color,
          case when p_size = 14 then 'NOBODY' else p_brand end as producer_name,
          'NEW-' || cast(p_partkey as varchar) as sku,
          '  a "new" part,' || chr(10) || p_type || ' ' as description,
          case when p_size = 11 then '-1' when p_size = 12 then '1.5'
            else cast(p_size as varchar) end as stock_qty,
          case when p_size <= 10 then cast(p_size * 10 + 36526 as varchar)
            when p_size <= 20 then '2001-05-06' when p_size <= 30 then '1999-12-31'
            when p_size = 35 then 'not a date' when p_size = 36 then null
            else '2001-05-06 10:00:00' end as ordered_on
        from part""",
    "read_rows": """
        select r.*, category_id, producer_id,
          try_cast(buy_price as decimal(18,2)) as buy, try_cast(sell_price as decimal(18,2)) as sell,
          case when try_cast(stock_qty as decimal(28,10)) = floor(try_cast(stock_qty as decimal(28,10)))
            then cast(try_cast(stock_qty as decimal(28,10)) as bigint) end as stock,
          case when regexp_full_match(ordered_on, '\\d+')
            then date '1899-12-30' + cast(ordered_on as integer)
            else try_cast(substring(ordered_on, 1, 10) as date) end as day
        from raw_products r
        left join categories c on r.category_name = c.category_name
        left join producers p on r.producer_name = p.producer_name""",
    "judged_rows": """
        select *, case when coalesce(product_name, '') = '' then 'missing_name'
          when ordered_on is not null and day is null then 'bad_date'
          when buy_price is not null and buy is null then 'bad_buy_price'
          when sell_price is not null and sell is null then 'bad_sell_price'
          when stock_qty is not null and stock is null then 'bad_stock_qty' end as reason
        from read_rows""",
    "accepted_rows": """
        select product_name, category_id, cast(buy as double) as buy_price,
          cast(sell as double) as sell_price, color, producer_id, sku, description,
          stock as stock_qty, day as ordered_on
        from judged_rows where reason is null""",
    "violations": """
        select sku as row_key, unnest([
          case when category_name not in (select category_name from categories)
            then 'category_not_listed' end,
          case when producer_name not in (select producer_name from producers)
            then 'producer_not_listed' end,
          case when buy is null or buy <> floor(buy) or buy < 0 then 'buy_price_not_whole' end,
          case when sell is null or sell <> floor(sell) or sell < 0
            then 'sell_price_not_whole' end,
          case when stock is null or stock < 0 then 'stock_qty_not_whole' end,
          case when ordered_on is not null and (day is null
              or day not between date '2000-01-01' and date '2100-12-31')
            then 'ordered_on_out_of_range' end]) as rule
        from read_rows""",
    "sales_after": """
        select sold_on, amount, product_id, place,
          case when taken is null then qty else qty - taken end as qty
        from sales s left join (select sale_id, cast(sum(qty) as bigint) as taken
          from return_verdicts where reason is null group by sale_id) t on s.sale_id = t.sale_id
        where taken is null or qty <> taken
        union all
        select sold_on, cast(sell_price * qty as decimal(18,2)), product_id, place, qty
        from sale_verdicts where reason is null""",
    "margins": """
        select sold_on, (sell_price - buy_price) * qty as margin
        from sales join products using (product_id)""",
    "by_product": """
        select product_id, cast(sum(qty) as bigint) as total_qty,
          cast(sum(case when sold_on >= date '2001-02-01' then qty end) as bigint) as recent_qty,
          sum(amount) as revenue
        from sales group by product_id""",
    "sellers": """
        select product_id, product_name, total_qty,
          row_number() over (order by total_qty desc nulls last, product_id) as place_from_best,
          row_number() over (order by total_qty nulls first, product_id desc) as place_from_worst
        from by_product join products using (product_id)""",
    "category_products": """
        select product_id, product_name, category_id, buy_price, sell_price, color, producer_id,
          sku, description, stock_qty, coalesce(total_qty, 0) as units_sold,
          coalesce(revenue, 0) as revenue
        from products left join by_product using (product_id)
        where category_id is not null
          and (coalesce(total_qty, 0) > 0 or coalesce(stock_qty, 0) > 0)""",
    "sheets": """
        select product_id, unnest([
          {'position': 1, 'parameter': 'name', 'v': product_name},
          {'position': 2, 'parameter': 'buy_price', 'v': cast(buy_price as varchar)},
          {'position': 3, 'parameter': 'sell_price', 'v': cast(sell_price as varchar)},
          {'position': 4, 'parameter': 'color', 'v': color},
          {'position': 5, 'parameter': 'stock', 'v': cast(stock_qty as varchar)},
          {'position': 6, 'parameter': 'units_sold', 'v': cast(units_sold as varchar)},
          {'position': 7, 'parameter': 'revenue', 'v': cast(revenue as varchar)}]) as entry
        from category_products""",
    "by_place": "select place, sum(amount) as total_sales from sales group by place",
    "zero_places": """
        select string_agg(p.place, ', ' order by p.place) as places, count(*) as place_count
        from places p left join by_place b on p.place = b.place
        where coalesce(total_sales, 0) = 0 having count(*) > 0""",
    "lowest_place": """
        select place, total_sales from by_place
        order by total_sales nulls first, place nulls first limit 1""",
    "top_product": """
        select product_id, product_name, total_qty, stock_qty
        from products join by_product using (product_id) where total_qty > 0
        order by total_qty desc, product_id limit 1""",
    "special_day": """
        select id, name, starts_on, ends_on, coalesce(name = 'Communion', false) as gift_season
        from special_days where ends_on >= date '2001-07-31' order by starts_on, id limit 1""",
    "producer_totals": """
        select producer_id, producer_name, cast(coalesce(sum(recent_qty), 0) as bigint) as recent_qty,
          cast(coalesce(sum(total_qty), 0) as bigint) as total_qty
        from producers join products using (producer_id)
        left join by_product using (product_id) group by producer_id, producer_name""",
    "producer_shares": """
        select *, case when total_qty > 0
            then (recent_qty * 20000 + total_qty) // (2 * total_qty) else 0 end as hundredths,
          case when total_qty > 0 then recent_qty * 100.0 / total_qty else 0 end as share
        from producer_totals""",
    "aged": """
        select product_id, product_name, date_diff('day', ordered_on, date '2001-07-31')
            as days_in_stock, stock_qty, coalesce(total_qty, 0) as total_qty,
          stock_qty + coalesce(total_qty, 0) as opening_qty
        from products left join by_product using (product_id)""",
    "slow": """
        select *, case when days_in_stock > 90 then 20 when days_in_stock > 60 then 10
            when days_in_stock > 30 then 5 end as discount,
          case when opening_qty > 0
            then (total_qty * 20000 + opening_qty) // (2 * opening_qty) else 0 end as hundredths
        from aged
        where days_in_stock > 30 and (opening_qty <= 0 or total_qty * 10 <= opening_qty)""",
    "sale_requests": """
        select sale_id as request_id, product_id, date_diff('day', date '1970-01-01', ship_day) as seq,
          case when units = 4 and line = 4 then -1 else qty end as qty, place, sold_on
        from sales_lines
        union all
        select sale_id, product_id, date_diff('day', date '1970-01-01', ship_day) + 1, qty, place,
          sold_on
        from sales_lines
        where qty = 5 and date_diff('day', date '1970-01-01', ship_day) % 5 = 0""",
    "sale_checks": """
        select r.*, p.sell_price, coalesce(p.stock_qty // 10, 0) as opening,
          case when fault is not null then fault
            when row_number() over (partition by request_id, fault order by seq) > 1
              then 'duplicate_request'
            when p.product_id is null then 'unknown_product' end as reason
        from (select *, case
            when qty is null or place is null or sold_on is null then 'missing_field'
            when qty < 1 then 'bad_qty'
            when sold_on > date '2001-07-31' then 'future_date' end as fault
          from sale_requests) r left join products p on r.product_id = p.product_id""",
    "sale_queue": """
        select *, row_number() over (partition by product_id order by seq, request_id) as turn
        from sale_checks where reason is null""",
    "sale_turns": """
        select request_id, product_id, turn, qty <= opening as granted,
          opening - case when qty <= opening then qty else 0 end as remaining
        from sale_queue where turn = 1
        union all
        select q.request_id, q.product_id, q.turn, q.qty <= t.remaining,
          t.remaining - case when q.qty <= t.remaining then q.qty else 0 end
        from sale_turns t join sale_queue q
          on q.product_id = t.product_id and q.turn = t.turn + 1""",
    "sale_verdicts": """
        select c.* exclude (reason, fault),
          coalesce(reason, case when not granted then 'insufficient_stock' end) as reason
        from sale_checks c left join sale_turns t on c.request_id = t.request_id""",
    "return_requests": """
        select md5(sale_id || '1') as request_id,
          case when units = 6 and line = 6 then 'x' || sale_id else sale_id end as sale_id,
          cast(1 as bigint) as seq,
          cast(case when units = 7 and line = 7 then null when line = 1 then units + 1
            when line = 2 then units else line + 1 end as bigint) as qty,
          tax >= 0.04 as defective,
          case when units = 8 then '' else 'returned' end as description
        from sales_lines where return_flag = 'R'
        union all
        select md5(sale_id || '2'), sale_id, 2, cast(line + 1 as bigint),
          case when units <> 9 then tax >= 0.02 end, 'again'
        from sales_lines where return_flag = 'R' and status = 'O'
        union all
        select md5(sale_id || '1'),
          case when units = 6 and line = 6 then 'x' || sale_id else sale_id end, 3, 5,
          tax >= 0.04, case when units = 8 then '' else 'returned' end
        from sales_lines where return_flag = 'R'
          and case when units = 7 and line = 7 then null when line = 1 then units + 1
            when line = 2 then units else line + 1 end = 5""",
    "return_checks": """
        select r.*, s.product_id, coalesce(s.qty, 0) as opening,
          case when fault is not null then fault
            when row_number() over (partition by request_id, fault order by seq) > 1
              then 'duplicate_request'
            when s.sale_id is null then 'unknown_sale' end as reason
        from (select *, case
            when qty is null or defective is null or coalesce(description, '') = ''
              then 'missing_field'
            when qty < 1 then 'bad_qty' end as fault
          from return_requests) r left join sales s on r.sale_id = s.sale_id""",
    "return_queue": """
        select *, row_number() over (partition by sale_id order by seq, request_id) as turn
        from return_checks where reason is null""",
    "return_turns": """
        select request_id, sale_id, turn, qty <= opening as granted,
          opening - case when qty <= opening then qty else 0 end as remaining
        from return_queue where turn = 1
        union all
        select q.request_id, q.sale_id, q.turn, q.qty <= t.remaining,
          t.remaining - case when q.qty <= t.remaining then q.qty else 0 end
        from return_turns t join return_queue q on q.sale_id = t.sale_id and q.turn = t.turn + 1""",
    "return_verdicts": """
        select c.* exclude (reason, fault),
          coalesce(reason, case when not granted then 'exceeds_sale' end) as reason
        from return_checks c left join return_turns t on c.request_id = t.request_id""",
    "new_products": """
        select case when size = 41 then '' else product_name end as product_name, category_id,
          buy_price, sell_price, color, producer_id,
          case when size = 42 then '' else 'ADD-' || sku end as sku, description,
          size as stock_qty, day as ordered_on
        from parts""",
    "new_checks": """
        select *, case when product_name = '' then 'missing_product_name'
          when category_id is null then 'missing_category_id'
          when producer_id is null then 'missing_producer_id'
          when sku = '' then 'missing_sku' end as reason
        from new_products""",
    "first_changes": """
        select case when size = 50 then -1 - product_id else product_id end as product_id,
          case when size <> 45 then cast(1 as bigint) end as seq,
          case when size = 41 then '' else product_name || ' II' end as product_name,
          category_id, buy_price, cast(sell_price + 1 as decimal(18,2)) as sell_price, color,
          producer_id, case when size <> 42 then sku end as sku, description,
          size as stock_qty, case when size <> 44 then day end as ordered_on, p_brand
        from parts""",
    "changes": """
        select * exclude (p_brand) from first_changes
        union all
        select * exclude (p_brand) replace (cast(2 as bigint) as seq, 'repainted' as color)
        from first_changes where p_brand = 'Brand#1'
        union all
        select * exclude (p_brand) replace ('undecided' as color)
        from first_changes where p_brand = 'Brand#2'""",
    "change_checks": """
        select c.* exclude (fault), case when fault is not null then fault
          when count(*) over (partition by c.product_id, seq, fault) > 1 then 'tied_seq'
          when p.product_id is null then 'unknown_product' end as reason
        from (select *, case when product_name = '' then 'missing_product_name'
            when category_id is null then 'missing_category_id'
            when producer_id is null then 'missing_producer_id'
            when coalesce(sku, '') = '' then 'missing_sku'
            when ordered_on is null then 'missing_ordered_on'
            when seq is null then 'missing_seq' end as fault
          from changes) c left join products p on c.product_id = p.product_id""",
    "last_changes": """
        select * from change_checks where reason is null
        qualify row_number() over (partition by product_id order by seq desc) = 1""",
}

_PRODUCT_ROW = """product_id, product_name, category_id, cast(buy_price as double) as buy_price,
  cast(sell_price as double) as sell_price, color, producer_id, sku, description, stock_qty,
  sold_qty, complaint_qty, ordered_on"""

_DETAILS = """
  select product_id, product_name, cast(buy_price as double) as buy_price,
    cast(sell_price as double) as sell_price, color, p.producer_id, sku, description,
    stock_qty, sold_qty, complaint_qty, ordered_on, category_name, producer_name
  from products p
  {how} join categories c on p.category_id = c.category_id
  {how} join producers m on p.producer_id = m.producer_id"""


def _margin(period: str) -> str:
    return f"""
      select {period} as period, cast(coalesce(sum(margin), 0) as double) as total_margin
      from margins group by 1"""


_PRODUCER_DAYS = """
  select producer_id, producer_name, recent_qty, total_qty,
    cast(hundredths as double) / 100 as recent_pct
  from producer_shares where share < {limit}"""


_ACTION_FEED = """
      select 1 as section, cast(0 as bigint) as tie_key, 'special_day_promotion' as type,
        cast(id as varchar) as id,
        case when gift_season then 'Gift promotion for ' else 'Promotion for ' end || name
          as title,
        name || case when gift_season
          then ' is near. Prepare gift offers.'
          else ' is near. Prepare offers.' end as description,
        'Run the offers from ' || strftime(starts_on, '%d-%m-%Y') || ' to '
          || strftime(ends_on, '%d-%m-%Y') || case when gift_season
          then '. Consider discounts, free delivery or gift wrapping.'
          else '. Consider discounts, bundles or extras.' end as more_info
      from special_day
      union all
      select 2, 0, 'zero_sales_cities', 'zero_sales', 'Places with no sales',
        'No revenue in: ' || places,
        'Consider discounts, marketing, or closing these places to save cost.'
      from {zero}
      union all
      select 2, 0, 'lowest_store_sales', coalesce(place, '(no place)'),
        'Place with the lowest sales: ' || coalesce(place, '(no place)'),
        'Total sales there: ' || cast(total_sales as varchar),
        'Consider discounts, marketing or a campaign to raise sales there.'
      from lowest_place where not exists (select 1 from {zero})
      union all
      select 3, 0, 'best_selling', cast(product_id as varchar),
        'Order more of: ' || product_name,
        'Best seller: ' || product_name || ' (' || cast(total_qty as varchar) || ' units sold)',
        'Consider a larger order; customers buy this product most often.'
      from top_product
      union all
      select 4, producer_id, 'producer_day', cast(producer_id as varchar),
        producer_name || ' Day',
        'Recent sales of ' || producer_name || ' are only ' || cast(hundredths // 100 as varchar) || '.'
          || lpad(cast(hundredths % 100 as varchar), 2, '0')
          || '% of all its sales.',
        'Hold a ' || producer_name || ' Day: add accessories, run promotions or an event.'
      from producer_shares where share < 40
      union all
      select 5, product_id, 'product_discount', cast(product_id as varchar),
        'Discount for: ' || product_name,
        cast(days_in_stock as varchar) || ' days in stock, only '
          || cast(hundredths // 100 as varchar) || '.'
          || lpad(cast(hundredths % 100 as varchar), 2, '0') || '% sold.',
        'Lower the price by ' || cast(discount as varchar) || '%.'
      from slow"""

_QUERIES = {
    "export_roundtrip": f"select {_PRODUCT_ROW} from products",
    "export_sales": """
      select sale_id, sold_on, cast(amount as double) as amount, product_id, place, qty
      from sales""",
    "export_returns": "select * from returned_goods",
    "export_returns_ranges": "select * from returned_goods",
    "import_products": "select * from accepted_rows",
    "import_rejected": """
      select product_name, category_name, buy_price, sell_price, color, producer_name, sku,
        description, stock_qty, ordered_on, reason
      from judged_rows where reason is not null""",
    "import_unresolved": """
      select sku, category_id, producer_id from accepted_rows
      where category_id is null or producer_id is null""",
    "import_appended": f"""
      select {_PRODUCT_ROW} from products
      union all
      select null, product_name, category_id, buy_price, sell_price, color, producer_id, sku,
        description, stock_qty, 0, 0, ordered_on
      from accepted_rows""",
    "import_ids": """
      select count(*) as ids, count(*) as distinct_ids,
        (select max(product_id) from products) + 1 as least,
        (select max(product_id) from products) + count(*) as highest
      from accepted_rows""",
    "import_dates": "select sku, ordered_on from accepted_rows",
    "intake_violations": "select row_key, rule from violations where rule is not null",
    "intake_violation_counts": """
      select rule, count(*) as row_count from violations where rule is not null group by rule""",
    "domain_values": """
      select distinct 'category' as domain, category_name as value from categories
      union all select distinct 'producer', producer_name from producers""",
    "product_list": """
      select product_id, product_name, cast(sell_price as double) as sell_price, stock_qty
      from products""",
    "product_details": _DETAILS.format(how="inner"),
    "product_details_left": _DETAILS.format(how="left"),
    "product_details_ids": _DETAILS.format(how="inner") + " where stock_qty = 0",
    "product_details_text_dates": _DETAILS.format(how="inner").replace(
        " ordered_on,",
        """ case product_id % 4
          when 0 then date '1970-01-01' - cast(product_id as integer)
          when 1 then date '5000-01-01' + cast(product_id // 86400 as integer)
          when 2 then date '1970-01-01' + cast(product_id * 1000 // 86400 as integer)
          else date '2001-05-06' end as ordered_on,""",
    ),
    "in_stock": """
      select product_id, product_name, cast(sell_price as double) as sell_price, stock_qty,
        color, category_name, producer_name
      from products join categories using (category_id) join producers using (producer_id)
      where stock_qty > 0""",
    "sales_list": """
      select sale_id, product_id, product_name, sold_on, cast(amount as double) as amount,
        place, qty
      from sales join products using (product_id)""",
    "returns_list": """
      select return_id, product_id, product_name,
        case when defective then 'yes' else 'no' end as defective, r.description
      from returned_goods r join products using (product_id)""",
    "margin_by_week": _margin("sold_on - cast(dayofweek(sold_on) as integer)"),
    "margin_by_month": _margin("cast(date_trunc('month', sold_on) as date)"),
    "margin_by_year": _margin("cast(date_trunc('year', sold_on) as date)"),
    "best_worst_seller": """
      select 'best' as kind, product_id, product_name, total_qty from sellers
      where place_from_best = 1
      union all
      select 'worst', product_id, product_name, total_qty from sellers
      where place_from_worst = 1""",
    "total_units_sold": "select cast(sum(qty) as bigint) as total_units from sales",
    "total_stock": "select cast(sum(stock_qty) as bigint) as total_stock from products",
    "units_by_mapped_place": """
      select p.place, lat, lng, cast(coalesce(sum(qty), 0) as bigint) as total_qty,
        sqrt(coalesce(sum(qty), 0)) * 2 as radius
      from places p left join sales s on p.place = s.place
      where p.place <> 'MIDDLE EAST' group by p.place, lat, lng""",
    "units_by_producer": """
      select producer_name, cast(sum(qty) as bigint) as total_qty
      from sales join products using (product_id) join producers using (producer_id)
      group by producer_name order by total_qty desc nulls last, producer_name""",
    "units_by_category": """
      select category_name, cast(sum(qty) as bigint) as total_qty
      from sales join products using (product_id) join categories using (category_id)
      group by category_name order by total_qty desc nulls last, category_name""",
    "revenue_by_place": """
      select place, cast(total_sales as double) as total_sales from by_place
      order by total_sales desc nulls last, place nulls first""",
    "active_categories": """
      select category_id, category_name from categories
      join products using (category_id) left join by_product using (product_id)
      group by category_id, category_name
      having coalesce(sum(total_qty), 0) > 0 or coalesce(sum(stock_qty), 0) > 0""",
    "category_products": """
      select * replace (cast(buy_price as double) as buy_price,
        cast(sell_price as double) as sell_price, cast(revenue as double) as revenue)
      from category_products""",
    "category_products_one": """
      select * replace (cast(buy_price as double) as buy_price,
        cast(sell_price as double) as sell_price, cast(revenue as double) as revenue)
      from category_products where category_id = 2""",
    "category_best_worst": """
      select category_id, 'best' as kind, product_id, product_name, units_sold
      from category_products
      qualify row_number() over (partition by category_id order by units_sold desc, product_id) = 1
      union all
      select category_id, 'worst', product_id, product_name, units_sold
      from category_products
      qualify row_number() over (partition by category_id order by units_sold, product_id desc) = 1
      """,
    "compare_products": """
      select coalesce(a.product_id, b.product_id - 1) as pair_id,
        coalesce(a.entry.position, b.entry.position) as position,
        coalesce(a.entry.parameter, b.entry.parameter) as parameter,
        a.entry.v as product_1, b.entry.v as product_2
      from sheets a full join sheets b
        on b.product_id = a.product_id + 1 and b.entry.position = a.entry.position
      where coalesce(a.product_id, b.product_id - 1) in (select product_id from products)""",
    "zero_sales_places": "select * from zero_places",
    "lowest_revenue_place": """
      select place, cast(total_sales as double) as total_sales from lowest_place""",
    "reorder_best_seller": "select * from top_product",
    "next_special_day": "select * from special_day",
    "producer_days": _PRODUCER_DAYS.format(limit=40),
    "producer_days_low": _PRODUCER_DAYS.format(limit=11),
    "slow_mover_discounts": """
      select product_id, product_name, days_in_stock, stock_qty, total_qty,
        cast(hundredths as double) / 100 as sold_pct, discount
      from slow""",
    "action_feed": _ACTION_FEED.format(zero="zero_places"),
    "action_feed_all_places_sell": _ACTION_FEED.format(
        zero="(select * from zero_places where false)"
    ),
    "apply_sales_accepted": """
      select request_id as sale_id, sold_on, cast(sell_price * qty as double) as amount,
        product_id, place, qty
      from sale_verdicts where reason is null""",
    "apply_sales_rejected": """
      select request_id, product_id, seq, qty, place, sold_on, reason
      from sale_verdicts where reason is not null""",
    "apply_sales_stock": """
      select p.product_id,
        case when sold is null then stock_qty // 10 else stock_qty // 10 - sold end as stock_qty,
        case when sold is null then sold_qty else sold_qty + sold end as sold_qty
      from products p left join (select product_id, cast(sum(qty) as bigint) as sold
        from sale_verdicts where reason is null group by product_id) s
        on p.product_id = s.product_id""",
    "apply_sales_changed": """
      select product_id, stock_qty // 10 - sold as stock_qty, sold_qty + sold as sold_qty
      from products join (select product_id, cast(sum(qty) as bigint) as sold
        from sale_verdicts where reason is null group by product_id) s using (product_id)""",
    "apply_sales_blocks_accepted": """
      select request_id as sale_id, sold_on, cast(sell_price * qty as double) as amount,
        product_id, place, qty
      from sale_verdicts where reason is null""",
    "apply_returns_accepted": """
      select request_id as return_id, product_id, defective, description
      from return_verdicts where reason is null""",
    "apply_returns_sales": """
      select s.sale_id, sold_on, cast(amount as double) as amount, product_id, place,
        case when taken is null then qty else qty - taken end as qty
      from sales s left join (select sale_id, cast(sum(qty) as bigint) as taken
        from return_verdicts where reason is null group by sale_id) t on s.sale_id = t.sale_id
      where taken is null or qty <> taken""",
    "apply_returns_stock": """
      select p.product_id,
        case when returned is null then stock_qty else stock_qty + sound end as stock_qty,
        case when returned is null then sold_qty else sold_qty - returned end as sold_qty
      from products p left join (select product_id, cast(sum(qty) as bigint) as returned,
          cast(sum(case when defective then 0 else qty end) as bigint) as sound
        from return_verdicts where reason is null group by product_id) r
        on p.product_id = r.product_id""",
    "apply_returns_rejected": """
      select request_id, sale_id, seq, qty, defective, description, reason
      from return_verdicts where reason is not null""",
    "apply_returns_changed_sales": """
      select sale_id, sold_on, cast(amount as double) as amount, product_id, place,
        qty - taken as qty
      from sales join (select sale_id, cast(sum(qty) as bigint) as taken
        from return_verdicts where reason is null group by sale_id) t using (sale_id)
      where qty <> taken""",
    "apply_returns_removed_sales": """
      select sale_id
      from sales join (select sale_id, cast(sum(qty) as bigint) as taken
        from return_verdicts where reason is null group by sale_id) t using (sale_id)
      where qty = taken""",
    "apply_returns_blocks_rejected": """
      select request_id, sale_id, seq, qty, defective, description, reason
      from return_verdicts where reason is not null""",
    "sales_store_after_returns": """
      select s.sale_id, sold_on, cast(amount as double) as amount, product_id, place,
        case when taken is null then qty else qty - taken end as qty
      from sales s left join (select sale_id, cast(sum(qty) as bigint) as taken
        from return_verdicts where reason is null group by sale_id) t on s.sale_id = t.sale_id
      where taken is null or qty <> taken""",
    "sales_store_lookup": """
      select sale_id, sold_on, cast(amount as double) as amount, product_id, place, qty
      from sales where sale_id in (select sale_id from return_requests)""",
    "rolled_sales": """
      select product_id, place, cast(greatest(sold_on - cast(dayofweek(sold_on) as integer),
          date_trunc('month', sold_on)) as date) as first_day,
        cast(coalesce(sum(qty), 0) as bigint) as units, count(qty) as unit_rows,
        cast(coalesce(sum(amount), 0) as double) as revenue, count(amount) as revenue_rows,
        count(*) as sale_rows
      from sales_after group by all""",
    "rolled_margin_by_week": """
      select sold_on - cast(dayofweek(sold_on) as integer) as period,
        cast(coalesce(sum((sell_price - buy_price) * qty), 0) as double) as total_margin
      from sales_after join products using (product_id) group by 1""",
    "rolled_revenue_by_place": """
      select place, cast(sum(amount) as double) as total_sales from sales_after
      group by place order by total_sales desc nulls last, place nulls first""",
    "add_products_ids": """
      select count(*) as ids, count(*) as distinct_ids, max(top) + 1 as least,
        max(top) + count(*) as highest
      from new_checks cross join (select greatest((select max(product_id) from products),
          (select max(product_id) from sales),
          (select max(product_id) from returned_goods)) as top) t
      where reason is null""",
    "add_products": f"""
      select {_PRODUCT_ROW} from products
      union all
      select null, product_name, category_id, cast(buy_price as double),
        cast(sell_price as double), color, producer_id, sku, description, stock_qty, 0, 0,
        ordered_on
      from new_checks where reason is null""",
    "add_products_rejected": """
      select * replace (cast(buy_price as double) as buy_price,
        cast(sell_price as double) as sell_price)
      from new_checks where reason is not null""",
    "update_products": """
      select product_id, n.product_name, n.category_id, cast(n.buy_price as double) as buy_price,
        cast(n.sell_price as double) as sell_price, n.color, n.producer_id, n.sku,
        n.description, n.stock_qty, sold_qty, complaint_qty, n.ordered_on
      from products p join last_changes n using (product_id)
      union all
      select """ + _PRODUCT_ROW + """ from products
      where product_id not in (select product_id from last_changes)""",
    "update_products_changed": """
      select product_id, n.product_name, n.category_id, cast(n.buy_price as double) as buy_price,
        cast(n.sell_price as double) as sell_price, n.color, n.producer_id, n.sku,
        n.description, n.stock_qty, sold_qty, complaint_qty, n.ordered_on
      from products p join last_changes n using (product_id)""",
    "update_products_rejected": """
      select * replace (cast(buy_price as double) as buy_price,
        cast(sell_price as double) as sell_price)
      from change_checks where reason is not null""",
    "delete_products": f"select {_PRODUCT_ROW} from products where stock_qty is null or stock_qty <> 0",
}


#: Queries that come to the rows of another one in another way.
_SAME = {
    "import_observed_counts": "intake_violation_counts",
    "import_observed_accepted": "import_products",
}


def _used(sql: str, found: dict[str, None]) -> None:
    """Collect the tables ``sql`` names, each after those it needs itself."""
    for name in _TABLES:
        if name not in found and re.search(rf"\b(from|join)\s+{name}\b", sql):
            own = re.sub(rf"\b(from|join)\s+{name}\b", " ", _TABLES[name])
            _used(own, found)
            found[name] = None


def _statement(sql: str) -> str:
    found: dict[str, None] = {}
    _used(sql, found)
    if not found:
        return sql
    tables = ",\n".join(f"{name} as ({_TABLES[name]})" for name in found)
    return f"with recursive {tables}\n{sql}"


def all_oracles() -> dict[str, str]:
    queries = _QUERIES | {name: _QUERIES[same] for name, same in _SAME.items()}
    return {name: _statement(sql) for name, sql in queries.items()}
