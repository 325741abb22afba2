"""The regression study on the feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield import constants as K
from emberfield.operators.design import (
    model_input, model_input_counts, quartile_profile, sample_summary, stratum)
from emberfield.operators.frequency import top_rows
from emberfield.operators.absorbed import fit_absorbed
from emberfield.operators.regression import CONST, Fit, coefficient_table, fit_ols, nested_rsquared
from emberfield.operators.rollup import group_rates
from emberfield.session import materialize

STRATA = {"fire": K.FIRE_CODES, "ems": K.EMS_CODES}


@dataclass
class FullModel:
    fit: Fit
    rsquared_base: float

    @property
    def delta(self) -> float:
        return self.fit.rsquared - self.rsquared_base


def full_model(df: DataFrame, response: str = "response_time_min") -> FullModel:
    """All incidents with controls and category dummies, against the socio columns alone."""
    fit = fit_ols(df, response, K.SOCIO_COLUMNS, K.CONTROL_COLUMNS, category="incident_category",
                  levels=K.CODE_BIN_LABELS)["all"]
    return FullModel(fit, nested_rsquared(fit, K.SOCIO_COLUMNS))


def stratum_model(df: DataFrame, response: str = "response_time_min") -> Fit:
    """The constant and the socio rows of a model with a dummy per code; the dummies are absorbed."""
    coded = df.withColumn("code", F.format_string("%03d", F.col("incident_code").cast("int")))
    return fit_absorbed(coded, response, K.SOCIO_COLUMNS, K.CONTROL_COLUMNS, absorb="code").fits.get("all")


def district_fire_rates(df: DataFrame) -> DataFrame:
    """Fire share per district with the district's socio columns; tiny districts drop out.

    The socio values are those of the district's earliest incident that has one.
    """
    rates = group_rates(
        df, "neighborhood", "incident_number", F.col("incident_code").between(*K.FIRE_CODES),
        [*K.SOCIO_COLUMNS, "total_population"], ["acs_year", "alarm_dttm", "incident_number"])
    return rates.where(F.col("total_population") > 100)


def run_study(features: DataFrame) -> dict[str, DataFrame]:
    """Every table of the study by name."""
    spark = features.sparkSession
    df = materialize(model_input(features), "model-input")
    out: dict[str, DataFrame] = {"rows": model_input_counts(features)}

    full = full_model(df)
    out["full_model"] = coefficient_table(spark, {"all": full.fit})
    out["full_vs_base"] = spark.createDataFrame(
        [(full.rsquared_base, full.fit.rsquared, full.delta)], "r2_base double, r2 double, delta double")

    socio = [CONST, *K.SOCIO_COLUMNS]
    for name, bounds in STRATA.items():
        part = stratum(df, "incident_code", bounds)
        fit = stratum_model(part)
        out[f"{name}_model"] = coefficient_table(spark, {name: fit} if fit else {}, socio)
        out[f"{name}_sample"] = sample_summary(part, "response_time_min")
        out[f"{name}_by_poverty"] = quartile_profile(part, "poverty_rate", "response_time_min")

    rates = materialize(district_fire_rates(df), "fire-rates")
    out["fire_rates"] = rates
    out["fire_rate_summary"] = sample_summary(rates, "rate_pct")
    out["fire_rate_top"] = top_rows(
        rates, "rate_pct", 5, ["neighborhood", "rate_pct", "poverty_rate", "median_household_income"],
        ["neighborhood"])
    complete = rates.dropna(subset=K.SOCIO_COLUMNS)
    out["fire_rate_model"] = coefficient_table(
        spark, fit_ols(complete, "rate_pct", K.SOCIO_COLUMNS, cov="classic"))
    out["clustered_model"] = clustered_model(df.dropna(subset=[*K.SOCIO_COLUMNS]))
    return out


def clustered_model(df: DataFrame, response: str = "response_time_min",
                    cluster: str = "neighborhood") -> DataFrame:
    """Socio model with errors clustered by district, whose values all its incidents share."""
    fits = fit_ols(df, response, K.SOCIO_COLUMNS, K.CONTROL_COLUMNS, cov="cluster", cluster=cluster)
    return coefficient_table(df.sparkSession, fits)
