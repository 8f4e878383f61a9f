"""Persona groups (gender x city x age band), min-max scored, and the best personas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.functions.exact import dec, div, exact_round
from custseg.operators.segments import joined_view
from custseg.params import DEFAULT, Params

PERSONA_KEYS = ("gender", "city", "age_group")
MEASURES = ("R", "F", "M", "gmv")


def persona_groups(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per persona: distinct customers, GMV (whole money units) and order-weighted mean R/F/M.

    Eager aggregation: every order of a customer carries the same scores and dimension
    attributes, so summing each customer's totals (monetary, n_orders) over the segment rows
    equals joining the orders fact back, without a second fact scan or an order-grain shuffle.
    AVG over order rows = sum(score * n_orders) / sum(n_orders). Customers missing from the
    dimension form the (NULL, NULL, NULL) group with no distinct customers, so the HAVING
    (customers > min_customers) drops it. Distinct customers are the sum of ``first_copy``, so
    the only exchange is of partial sums per persona. R, F, M are exact decimals rounded to 2 places and
    gmv to 0 places, as later scores read the rounded values.
    """
    view = joined_view(rows)
    weight = F.when(F.col("R").isNotNull(), F.col("n_orders"))
    sums = [F.sum("first_copy").alias("customers"),
            F.sum("monetary").alias("gmv_sum"),
            F.sum(weight).alias("w")]
    sums += [F.sum(F.col(s).cast("long") * F.col("n_orders")).alias(f"{s}_sum") for s in "RFM"]
    g = view.groupBy(*PERSONA_KEYS).agg(*sums).filter(F.col("customers") > params.min_customers)
    return g.select(
        *PERSONA_KEYS, "customers",
        exact_round(div(F.col("gmv_sum"), dec(params.money_scale)), 0).alias("gmv"),
        *[exact_round(div(F.col(f"{s}_sum"), F.col("w")), 2).alias(s) for s in "RFM"],
    )


def persona_bounds(groups: DataFrame) -> DataFrame:
    """One row: min and max of R, F, M and gmv over the persona groups."""
    return groups.agg(*[agg.alias(name) for name, agg in _bounds().items()])


def _bounds() -> dict:
    return {f"{kind}_{m.lower()}": agg(m) for m in MEASURES
            for kind, agg in (("min", F.min), ("max", F.max))}


def persona_scores(groups: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Min-max scaled measures and the weighted persona score, all rounded to 2 places.

    The final score weighs the *unrounded* scaled measures. A zero range (one group, or equal
    values) yields NULL scores unless ``strict_division`` asks for the division error. The
    bounds are one scalar subquery: minima and maxima combine in every task, and no task sees all
    groups, however many there are.
    """
    bounds = groups.agg(F.struct(*[agg.alias(name) for name, agg in _bounds().items()])).scalar()
    groups = groups.withColumn("bounds", bounds)        # one column: one subquery for all measures
    bound = {name: F.col("bounds")[name] for name in _bounds()}
    guard = not params.strict_division
    weights = {"R": params.weight_r, "F": params.weight_f, "M": params.weight_m,
               "gmv": params.weight_gmv}
    scaled, terms = {}, []
    for m in MEASURES:
        low = m.lower()
        span = bound[f"max_{low}"] - bound[f"min_{low}"]
        offset = F.col(m) - bound[f"min_{low}"]
        scaled[m] = div(offset, span, guard_zero=guard)
        terms.append(div(dec(weights[m]) * offset, span, guard_zero=guard))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return groups.select(
        "city", "gender", "age_group", "customers", "gmv",
        exact_round(scaled["R"], 2).alias("score_R"),
        exact_round(scaled["F"], 2).alias("score_F"),
        exact_round(scaled["M"], 2).alias("score_M"),
        exact_round(scaled["gmv"], 2).alias("score_GMV"),
        exact_round(total, 2).alias("final_persona_score"),
        "R", "F", "M",
    )


def best_personas(scores: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Personas whose *rounded* final score reaches the threshold."""
    return (scores.filter(F.col("final_persona_score") >= dec(params.best_threshold))
            .select("city", "gender", "age_group"))


def best_customers(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Segment rows of the best personas, with their persona label ``city, gender, age``.

    Equality on the three keys: a NULL attribute never matches. ``best`` holds one row per best
    persona; derived from a written table, its size lets the planner broadcast it (below its
    threshold) without shuffling the customers on these few keys.
    """
    view = joined_view(rows).filter(F.col("matched"))
    j = view.join(best, [view[k] == best[k] for k in PERSONA_KEYS], "inner")
    return j.select(
        view["customer_id"],
        F.concat(view["city"], F.lit(", "), view["gender"], F.lit(", "), view["age_group"])
        .alias("cust_group"),
    )


def best_customer_weights(best_cust: DataFrame) -> DataFrame:
    """customer_id -> how many best-customer rows it has (1 unless the dimension repeats it).

    Joining orders to this weight table instead of the raw rows keeps the SQL fan-out
    (every order counted once per matching row) without duplicating order rows.
    """
    return best_cust.groupBy("customer_id").agg(F.count(F.lit(1)).alias("m"))
