"""Daily series features, key lookups, label columns, imputation and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

LAGS = (1, 2, 3, 7)
ROLLING_DAYS = 7


def daily_units(sales: DataFrame, keys: list[str], at: str, quantity: str) -> DataFrame:
    """Units per key and day.  A series then holds at most one row per calendar day, which
    bounds every window over it however many sales a key has."""
    day = F.to_date(at)
    return sales.groupBy(*keys, day.alias("transaction_date")).agg(
        F.sum(quantity).cast("long").alias("units_sold"))


def lag_features(daily: DataFrame, keys: list[str], order="transaction_date", value="units_sold", lags=LAGS, rolling=ROLLING_DAYS) -> DataFrame:
    """Earlier values, trailing mean, day of week (1 = Sunday) and the next value as target.

    All columns share one window specification, hence one shuffle and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cols: dict[str, Column] = {f"{value}_d{n}": F.lag(value, n).over(w) for n in lags}
    cols[f"mean_{rolling}d_{value}"] = F.avg(value).over(w.rowsBetween(1 - rolling, 0))
    cols["dow"] = F.dayofweek(order)
    cols[f"target_{value}"] = F.lead(value, 1).over(w)
    return daily.withColumns(cols)


def lag_columns(value="units_sold", lags=LAGS, rolling=ROLLING_DAYS) -> list[str]:
    return [f"{value}_d{n}" for n in lags] + [f"mean_{rolling}d_{value}"]


def fill_with_group_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """NULLs become the mean of the key's other values (same partitioning as the lags)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.avg(c).over(w)) for c in cols})


def feature_lookup(facts: DataFrame, features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Facts with the named features of their key; a key without features keeps NULLs."""
    return facts.join(features.select(*keys, *names), keys, "left")


def primary_key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys used more than once, rows with a NULL in the key."""
    nulls = F.when(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull(), F.col("_n"))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("null_key_rows"))


def write_feature_table(features: DataFrame, path: str, keys: list[str], base: DataFrame | None = None) -> None:
    """Write a feature table after checking its key; with ``base`` merge into its rows."""
    from weir.operators.cdc import upsert

    check = primary_key_check(features, keys).first()
    if check.duplicate_keys or check.null_key_rows:
        raise ValueError(f"{keys} is no key: {check.asDict()}")
    rows = features if base is None else upsert(base, features, keys)
    rows.write.parquet(path)


def binary_label(status: str, bad: list[str], good: list[str]) -> Column:
    """'true' for the bad values, 'false' for the good ones, NULL for all others."""
    return F.when(F.col(status).isin(bad), "true").when(F.col(status).isin(good), "false")


@dataclass(frozen=True)
class Scaling:
    """Means for missing values, then centre and population deviation after filling."""

    fill: dict[str, float]
    centre: dict[str, float]
    spread: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, mean in self.fill.items():
            filled = F.coalesce(F.col(c).try_cast("double"), F.lit(mean))
            out[c] = (filled - F.lit(self.centre[c])) / F.lit(self.spread[c] or 1.0)
        return df.withColumns(out)


def fit_scaling(df: DataFrame, cols: list[str]) -> Scaling:
    """One aggregate, one row to the driver.

    Filling NULLs with the mean keeps the mean, and only thins the variance out by the
    share of filled rows, so both follow from counts and moments of the values present.
    """
    num = {c: F.col(c).try_cast("double") for c in cols}
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(num[c]).alias(f"m_{c}") for c in cols],
        *[F.var_pop(num[c]).alias(f"v_{c}") for c in cols],
        *[F.count(num[c]).alias(f"n_{c}") for c in cols]).first()
    mean = {c: row[f"m_{c}"] if row[f"m_{c}"] is not None else 0.0 for c in cols}
    spread = {c: ((row[f"v_{c}"] or 0.0) * row[f"n_{c}"] / max(row["_rows"], 1)) ** 0.5 for c in cols}
    return Scaling(mean, dict(mean), spread)
