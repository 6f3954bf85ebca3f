"""Budget, expected and forecast figures of labour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quantity counts as given above this.
GIVEN = 0.0001
WARN_SHARE = 0.8


def expected_hours(planned: Column, actual: Column, complete: Column) -> Column:
    done = complete & (actual > GIVEN)
    return F.when(done, actual).otherwise(actual + F.greatest(F.lit(0).cast("decimal(18,2)"), planned - actual))


def tone(budget: Column, used: Column) -> Column:
    """none, over, warn (from 80 %) or ok."""
    return F.when(F.coalesce(budget, F.lit(0)) <= GIVEN, "none").when(used > budget, "over").when(used * 100 >= budget * 80, "warn").otherwise("ok")


def warnings(**flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def percent(a: Column, b: Column, places: int = 1) -> Column:
    return F.when(b > GIVEN, F.round(100 * a / b, places))


def status(budget: Column, used: Column, planned: Column, actual: Column, budget_price: Column, actual_price: Column) -> Column:
    """struct<remaining, overrun, percent, tone, warnings> of hours and prices.

    Without a budget there is no share; any warning makes the tone "over", which else begins above 100 %
    and "warn" at 80 %; a tone without a reason of its own has one of the hours.
    """
    given = F.coalesce(budget, F.lit(0)) > GIVEN
    over = lambda a, b: F.coalesce(a > b + GIVEN, F.lit(False))
    told = warnings(**{"actual above budget": given & over(actual, budget), "planned above budget": given & over(planned, budget), "price above budget": over(actual_price, budget_price)})
    share = F.round(used / budget * 100).cast("int")
    own = F.when((share > 100) | (F.size(told) > 0), "over").when(share >= 80, "warn").otherwise("ok")
    extra = F.when((own == "over") & (F.size(told) == 0), F.array(F.lit("hours used up"))).when(own == "warn", F.array(F.lit("hours nearly used up"))).otherwise(F.array().cast("array<string>"))
    zero = F.lit(0)
    return F.struct(
        F.when(given, F.round(F.greatest(zero, budget - used), 2)).alias("remaining"),
        F.when(given, F.round(F.greatest(zero, used - budget), 2)).otherwise(0).alias("overrun"),
        F.when(given, share).alias("percent"),
        F.when(given, own).when(F.size(told) > 0, "over").otherwise("none").alias("tone"),
        F.when(given, F.concat(told, extra)).otherwise(told).alias("warnings"),
    )


def finance(order: Column, budget: Column, actual: Column) -> Column:
    """struct of whole cents and shares in percent: budget_result, result, margin_percent, cost_delta, delta_percent,
    result_tone and budget_tone; null what needs an order (or one above nothing), or a budget."""
    share = lambda a, b: F.when(b != 0, F.round(a.cast("decimal(20,2)") / b * 100, 1).cast("double"))
    result, delta = order - actual, actual - budget
    return F.struct(
        (order - budget).alias("budget_result"), result.alias("result"), share(result, order).alias("margin_percent"), delta.alias("cost_delta"), share(delta, budget).alias("delta_percent"),
        F.when(order.isNull(), "none").when(result < 0, "over").otherwise("ok").alias("result_tone"), F.when(delta > 0, "over").otherwise("ok").alias("budget_tone"),
    )


def accounted(status_: Column, submitted: Column, approved: Column) -> Column:
    """struct<hours, adjusted>: approved hours (none: 0) of approved entries, else the submitted ones; adjusted if
    a review gave others than were submitted."""
    done = status_ == "approved"
    changed = done & approved.isNotNull() & (F.abs(approved - submitted) > 0.01)
    return F.struct(F.when(done, F.coalesce(approved, F.lit(0))).otherwise(submitted).alias("hours"), F.coalesce(changed, F.lit(False)).alias("adjusted"))


def behind(planned_end: Column, remaining: Column, today: Column, days: int = 2) -> Column:
    """Whether work that isn't done is due by so many days from now."""
    return F.coalesce((remaining > 0) & (planned_end <= F.date_add(today, days)), F.lit(False))
