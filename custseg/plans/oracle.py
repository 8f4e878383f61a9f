"""Independent DuckDB SQL for every registered query (the correctness oracle).

Every query is written for its own result on a shared customer profile:

* ``cust``: one row per customer of the orders, with counters and distinct days from lists;
* ``scores``: tile numbers by arithmetic on the place in an ordered list of the customers;
* ``profile``: scores and dimension attributes, one row per dimension match;
* personas are sums over the profile, their bounds are window aggregates;
* gaps come from each customer's two smallest order times, quantiles from indexing the ordered
  list of gaps, voucher rates from one conditional aggregate over all orders.

NULL placement (ASC NULLS LAST, DESC NULLS FIRST), tie-breaks by customer id and every ROUND on a
value first cast to DECIMAL(38,10) are spelled out. The test tables are bound onto the logical
schema by the same rules as ``custseg.sources.bind_testdata``.
"""

from __future__ import annotations

from custseg.params import DEFAULT, Params

BINDINGS = """
orders_b AS (
  SELECT
    o_orderkey AS order_id,
    o_custkey AS customer_id,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST((o_orderkey * 7919) % 86400 AS BIGINT))
      AS created_at,
    CAST(strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS INTEGER) AS order_date_key,
    CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal,
    CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
              THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(3,2))
              ELSE 0 END AS DECIMAL(18,2)) AS platform_voucher,
    CAST(CASE WHEN o_orderstatus = 'P'
              THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.03 AS DECIMAL(3,2))
         END AS DECIMAL(18,2)) AS shop_discount,
    CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN 1 ELSE 0 END
         AS DECIMAL(18,2)) AS shipping_discount
  FROM orders
),
items_b AS (
  SELECT
    l_orderkey AS order_id,
    l_partkey AS product_id,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
         AS DECIMAL(18,4)) AS line_total
  FROM lineitem
),
products_b AS (
  SELECT p_partkey AS product_id, p_type AS cat1_name FROM part
),
geo AS (
  SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
),
customers_b AS (
  SELECT key AS customer_id, CASE WHEN key % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         r_name AS city, CAST(2001 - (16 + (key * 37) % 33) AS INTEGER) AS birth_year, device
           AS preferred_device
  FROM ({dimension}) c LEFT JOIN geo ON c.nation = n_nationkey
)"""

_DIMENSIONS = {
    "customer": "SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS device "
                "FROM customer",
    "supplier": "SELECT s_suppkey AS key, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS device "
                "FROM supplier",
}

# Fixed values (age bands and segment rules), as plain CASE expressions over computed columns.
AGE_CASE = """CASE
      WHEN age < 18 THEN 'small students (<18)'
      WHEN age <= 24 THEN 'big students (18-24)'
      WHEN age <= 34 THEN 'young people (25-34)'
      WHEN age <= 44 THEN 'middle aged (35-44)'
      ELSE 'seniors (>44)'
    END"""

SEGMENT_CASE = """CASE
      WHEN R >= 4 AND F >= 4 AND M >= 4 THEN 'Champions'
      WHEN R >= 4 AND F >= 3 AND M >= 3 THEN 'Loyalists'
      WHEN R = 3 AND F >= 3 AND M >= 3 THEN 'Slipping Loyalists'
      WHEN R >= 4 AND F <= 2 THEN 'New Customers'
      WHEN R >= 3 AND F <= 2 AND M >= 4 THEN 'Whales'
      WHEN R <= 2 AND F >= 4 AND M >= 4 THEN 'Cannot lose them'
      WHEN R <= 2 AND F <= 2 AND M <= 2 THEN 'Lost'
      ELSE 'Potential / At Risk'
    END"""


def _round(value: str, digits: int) -> str:
    return f"ROUND(CAST({value} AS DECIMAL(38,10)), {digits})"


def _double(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def _tile(tiles: int) -> str:
    """Tile of place ``i`` (from 0) among ``n``: the first n % tiles tiles hold one row more."""
    small, more = f"(n // {tiles})", f"(n % {tiles})"
    head = f"({more} * ({small} + 1))"
    return (f"CASE WHEN i < {head} THEN i // ({small} + 1) "
            f"ELSE {more} + (i - {head}) // {small} END + 1")


def _score(name: str, order: str, tiles: int) -> str:
    """id -> tile, from the list of customers in ``order``."""
    return f"""{name}_score AS (
  SELECT id, {_tile(tiles)} AS tile
  FROM (SELECT unnest(ids) AS id, unnest(range(len(ids))) AS i, len(ids) AS n
        FROM (SELECT list(customer_id ORDER BY {order}, customer_id ASC NULLS LAST) AS ids
              FROM cust))
)"""


def _profile(p: Params, dimension: str = "customer") -> str:
    return BINDINGS.replace("{dimension}", _DIMENSIONS[dimension]) + f""",
today AS (SELECT CAST(MAX(created_at) AS DATE) AS d FROM orders_b),
cust AS (
  SELECT customer_id,
         (SELECT d FROM today) - CAST(MAX(created_at) AS DATE) AS recency,
         len(list_distinct(list(CAST(created_at AS DATE)))) AS frequency,
         SUM(subtotal) AS monetary, COUNT(*) AS n_orders
  FROM orders_b GROUP BY ALL
),
{_score("r", "recency DESC NULLS FIRST", p.buckets)},
{_score("f", "frequency ASC NULLS LAST", p.buckets)},
{_score("m", "monetary ASC NULLS LAST", p.buckets)},
scores AS (
  SELECT *, concat(R, F, M) AS rfm, {SEGMENT_CASE} AS segment
  FROM (SELECT cust.*, r_score.tile AS R, f_score.tile AS F, m_score.tile AS M
        FROM cust, r_score, f_score, m_score
        WHERE cust.customer_id IS NOT DISTINCT FROM r_score.id
          AND cust.customer_id IS NOT DISTINCT FROM f_score.id
          AND cust.customer_id IS NOT DISTINCT FROM m_score.id)
),
bands AS (
  SELECT *, {AGE_CASE} AS age_group
  FROM (SELECT *, year((SELECT d FROM today)) - birth_year AS age FROM customers_b)
),
profile AS (
  SELECT s.* EXCLUDE (customer_id), b.customer_id, b.gender, b.city, b.preferred_device,
         -- an unknown customer still gets the last band here; see its uses
         coalesce(b.age_group, 'seniors (>44)') AS age_group
  FROM scores s LEFT JOIN bands b ON s.customer_id = b.customer_id
)"""


def _cohort(p: Params, dimension: str = "customer") -> str:
    """Personas with scores, and the customers of the best ones (one row per profile row)."""
    def scaled(v: str) -> str:
        return f"({v} - MIN({v}) OVER ()) / NULLIF(MAX({v}) OVER () - MIN({v}) OVER (), 0)"

    def mean(v: str) -> str:
        return f"{_round(f'SUM({v} * n_orders) / CAST(SUM(n_orders) AS DOUBLE)', 2)} AS {v}"

    total = " + ".join(f"{w} * {scaled(v)}" for w, v in (
        (p.weight_r, "R"), (p.weight_f, "F"), (p.weight_m, "M"), (p.weight_gmv, "gmv")))
    return _profile(p, dimension) + f""",
persona AS (
  SELECT gender, city, age_group, COUNT(DISTINCT customer_id) AS customers,
         {_round(f"SUM(monetary) / {p.money_scale}", 0)} AS gmv,
         {mean("R")}, {mean("F")}, {mean("M")}
  FROM profile WHERE customer_id IS NOT NULL
  GROUP BY ALL HAVING customers > {p.min_customers}
),
rated AS (
  SELECT city, gender, age_group, customers, gmv,
         {_round(scaled("R"), 2)} AS score_R, {_round(scaled("F"), 2)} AS score_F,
         {_round(scaled("M"), 2)} AS score_M, {_round(scaled("gmv"), 2)} AS score_GMV,
         {_round(total, 2)} AS final_persona_score
  FROM persona
),
cohort AS (
  SELECT customer_id, concat_ws(', ', city, gender, age_group) AS cust_group
  FROM profile SEMI JOIN (FROM rated WHERE final_persona_score >= {p.best_threshold})
       USING (city, gender, age_group)
  WHERE customer_id IS NOT NULL
),
times AS (SELECT customer_id, COUNT(*) AS m FROM cohort GROUP BY ALL)"""


def _gaps(p: Params) -> str:
    return _cohort(p) + f""",
gap AS (
  SELECT customer_id,
         {_round("EPOCH(t[2] - t[1]) / 86400.0", p.gap_decimals)} AS diff
  FROM (SELECT customer_id, list(created_at ORDER BY created_at ASC NULLS LAST, order_id) AS t
        FROM cohort JOIN orders_b USING (customer_id) GROUP BY ALL)
),
ordered AS (SELECT list(diff ORDER BY diff ASC NULLS LAST, customer_id) AS d FROM gap)"""


def _at(fraction: str) -> tuple[str, str]:
    """(position, value) of a midpoint quantile on the ordered list ``d``."""
    at = f"(1 + {fraction} * (len(d) - 1))"
    return at, f"list_avg([d[CAST(FLOOR({at}) AS INT)], d[CAST(CEIL({at}) AS INT)]])"


def _lines(p: Params) -> str:
    return _cohort(p) + """,
line AS (
  SELECT cust_group, cat1_name, product_id IS NOT NULL AND known AS matched, line_total,
         hour(created_at) AS hour_
  FROM cohort JOIN orders_b USING (customer_id) LEFT JOIN items_b USING (order_id)
       LEFT JOIN (SELECT *, TRUE AS known FROM products_b) USING (product_id)
)"""


_KINDS = (("platform_voucher_usage_pct", "platform_voucher > 0"),
          ("shop_discount_usage_pct", "shop_discount > 0"),
          ("shipping_discount_usage_pct", "shipping_discount > 0"),
          ("product_voucher_usage_pct", "(platform_voucher > 0 OR shop_discount > 0)"))


def _vouchers(p: Params, labelled: bool) -> str:
    """Both rows from one aggregate over all orders, the cohort's weighted by its multiplicity."""
    def rates(weight: str, label: str) -> str:
        parts = [f"'{label}' AS cohort"] if labelled else []
        for name, cond in _KINDS:
            share = (f"NULLIF(SUM(CASE WHEN {cond} THEN {weight} END), 0) * 1.0 "
                     f"/ SUM(CASE WHEN order_id IS NOT NULL THEN {weight} END)")
            parts.append(f"{_double(_round(share, 4))} AS {name}")
        return "struct_pack(" + ", ".join(
            f"{x.rsplit(' AS ', 1)[1]} := {x.rsplit(' AS ', 1)[0]}" for x in parts) + ")"

    return f"""WITH {_cohort(p)},
used AS (
  SELECT [{rates("coalesce(m, 0)", "best_customers")}, {rates("1", "all_orders")}] AS pair
  FROM orders_b LEFT JOIN times USING (customer_id)
)
SELECT {"" if labelled else "DISTINCT"} unnest(pair, recursive := true) FROM used"""


def _profile_queries(p: Params, dimension: str, suffix: str) -> dict[str, str]:
    profile = "WITH " + _profile(p, dimension)
    share = _round("SUM(monetary) * 100.0 / (SELECT SUM(subtotal) FROM orders_b)", 2)
    return {
        "customer_segments" + suffix: profile + """
SELECT customer_id, gender, age_group, city, preferred_device, rfm, segment AS segmentation
FROM profile""",
        "segment_gmv_share" + suffix: profile + f"""
SELECT CASE WHEN customer_id IS NOT NULL THEN segment END AS segment,
       {_double(share)} AS segment_gmv_pct
FROM profile GROUP BY 1""",
    }


def _persona_groups(p: Params, dimension: str = "customer") -> str:
    return f"""WITH {_cohort(p, dimension)}
SELECT gender, city, age_group, customers, CAST(gmv AS BIGINT) AS gmv, {_double("R")} AS R,
       {_double("F")} AS F, {_double("M")} AS M
FROM persona"""


def build_partial(p: Params) -> dict[str, str]:
    """The queries over a dimension that lacks many customers."""
    return _profile_queries(p, "supplier", "_partial") | {
        "persona_groups_partial": _persona_groups(p, "supplier"),
        "best_customers_partial": f"WITH {_cohort(p, 'supplier')} FROM cohort",
    }


def build(p: Params = DEFAULT, suffix: str = "") -> dict[str, str]:
    """Oracle SQL per query name (persona-dependent names get ``suffix``)."""
    q: dict[str, str] = {}
    if not suffix:
        profile = "WITH " + _profile(p)
        q |= _profile_queries(p, "customer", "")
        q["as_of_date"] = "SELECT CAST(MAX(o_orderdate) AS DATE) AS as_of_date FROM orders"
        q["customer_metrics"] = profile + f"""
SELECT customer_id, recency, CAST(frequency AS BIGINT) AS frequency,
       {_double("monetary")} AS monetary, n_orders
FROM cust"""
        q["quantile_scores"] = profile + " SELECT customer_id, R, F, M, rfm FROM scores"
        q["quantile_scores_narrowed"] = q["quantile_scores"]
        q["segment_labels"] = profile + " SELECT customer_id, R, F, M, segment FROM scores"
        q["age_bands"] = profile + " SELECT customer_id, birth_year, age_group FROM bands"

    cohort = "WITH " + _cohort(p)
    bounds = ", ".join(
        f"CAST({kind}({m}) AS {'BIGINT' if m == 'gmv' else 'DOUBLE'}) AS {kind}_{m.lower()}"
        for m in ("R", "F", "M", "gmv") for kind in ("min", "max"))
    scores = ", ".join(f"{_double(c)} AS {c}" for c in (
        "score_R", "score_F", "score_M", "score_GMV", "final_persona_score"))
    q["persona_groups" + suffix] = _persona_groups(p)
    q["persona_bounds" + suffix] = cohort + f" SELECT {bounds} FROM persona"
    q["persona_scores" + suffix] = cohort + f"""
SELECT city, gender, age_group, customers, CAST(gmv AS BIGINT) AS gmv, {scores}
FROM rated ORDER BY final_persona_score DESC NULLS FIRST, city, gender, age_group"""
    q["best_personas" + suffix] = cohort + f"""
SELECT city, gender, age_group FROM rated WHERE final_persona_score >= {p.best_threshold}"""
    q["best_customers" + suffix] = cohort + " FROM cohort"

    for name, known, top in (("persona_category_gmv", False, None), ("top_categories", False, 1),
                             ("top_categories_known", True, 1),
                             ("top3_categories_known", True, 3)):
        q[name + suffix] = f"""WITH {_lines(p)},
by_category AS (
  SELECT cust_group, cat1_name, {_round(f"SUM(line_total) / {p.money_scale}", 0)} AS gmv
  FROM line {"WHERE cat1_name IS NOT NULL" if known else ""} GROUP BY ALL
)
SELECT cust_group, cat1_name, CAST(gmv AS BIGINT) AS gmv,
       row_number() OVER (PARTITION BY cust_group
                          ORDER BY gmv DESC NULLS FIRST, cat1_name ASC NULLS LAST) AS gmv_rank
FROM by_category {f"QUALIFY gmv_rank <= {top}" if top else ""}"""

    hours = f"""WITH {_lines(p)},
by_hour AS (
  SELECT hour_, CAST({_round(f"SUM(line_total) / {p.money_scale}", 0)} AS BIGINT) AS gmv
  FROM line WHERE matched GROUP BY ALL
)"""
    q["hourly_gmv" + suffix] = hours + " SELECT hour_, gmv FROM by_hour"
    q["hourly_gmv_ranked" + suffix] = hours + """
SELECT hour_, gmv, row_number() OVER (ORDER BY gmv DESC NULLS FIRST, hour_) AS gmv_rank
FROM by_hour"""

    gaps = "WITH " + _gaps(p)
    q["first_gap" + suffix] = gaps + f" SELECT customer_id, {_double('diff')} AS diff FROM gap"
    q["order_gaps" + suffix] = cohort + f"""
SELECT customer_id, order_id, row_number() OVER of_customer AS rn_order,
       {_double(_round("EPOCH(lead(created_at) OVER of_customer - created_at) / 86400.0",
                       p.gap_decimals))} AS diff
FROM cohort JOIN orders_b USING (customer_id)
WINDOW of_customer AS (PARTITION BY customer_id ORDER BY created_at ASC NULLS LAST, order_id)"""
    rows = " UNION ALL ".join(
        f"SELECT {_double(f)} AS fraction, {_double(_at(f)[0])} AS position, "
        f"{_double(_round(_at(f)[1], 5))} AS value FROM ordered WHERE len(d) > 0"
        for f in p.quantile_fractions)
    q["midpoint_quantiles" + suffix] = gaps + " " + rows
    q1, median, q3 = (_double(_round(f"(SELECT {_at(f)[1]} FROM ordered)", 2))
                      for f in p.quantile_fractions)
    q["repeat_gap_stats" + suffix] = gaps + f"""
SELECT {_double("MIN(diff)")} AS min_diff, {_double("MAX(diff)")} AS max_diff,
       {_double(_round("AVG(diff)", 2))} AS avg_diff, {q1} AS q1_diff, {median} AS median_diff,
       {q3} AS q3_diff
FROM gap"""

    q["voucher_usage" + suffix] = _vouchers(p, False)
    q["voucher_usage_labelled" + suffix] = _vouchers(p, True)
    gmv = f"SUM(subtotal * m) / {p.money_scale}"
    q["day_type_performance" + suffix] = cohort + f"""
SELECT CASE day(created_at) WHEN month(created_at) THEN 'Double Day'
            WHEN {p.sale_day} THEN 'EOM Sale Day' ELSE 'Normal Day' END AS day_type,
       CAST({_round(f"{gmv} / COUNT(DISTINCT order_date_key)", 0)} AS BIGINT) AS adgmv,
       CAST({_round(f"{gmv} / SUM(m) FILTER (order_id IS NOT NULL)", 0)} AS BIGINT) AS aov
FROM orders_b JOIN times USING (customer_id) GROUP BY 1"""
    return q
