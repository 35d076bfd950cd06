"""Donor risk score by year-dependent log-linear formulas, and its percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of the two published donor risk formulas, by term.
EARLIER = {
    "age": 0.0128, "age_over_50": 0.0107, "age_under_18": -0.0194, "height": -0.0464, "weight": -0.0199, "race": 0.1790,
    "hypertension": 0.1260, "diabetes": 0.1300, "stroke": 0.0881, "creatinine": 0.2200, "creatinine_over": -0.2090, "hcv": 0.2400, "dcd": 0.1330,
}
LATER = {
    "age": 0.0092, "age_over_50": 0.0067, "age_under_18": 0.0113, "height": -0.0557, "weight": -0.0333,
    "hypertension": 0.1106, "diabetes": 0.2577, "stroke": 0.0743, "creatinine": 0.2128, "creatinine_over": -0.2199, "dcd": 0.1966,
}
EARLIER_YEARS, LATER_YEARS = (2012, 2022), (2023, 2025)
SCORE_BINS = ["0-20", "20-40", "40-60", "60-80", "80-100"]


def log_risk(b: dict[str, float]) -> Column:
    """Sum of the terms of a formula; null if any is. Imputation shares ``htn_scale`` and ``diab_scale`` stand for unknowns."""
    c = F.col
    age, weight = c("age"), c("weight")
    creatinine = F.least(F.coalesce(c("creat"), c("final_creat"), c("peak_creat")), F.lit(8.0))
    over = F.when(creatinine > 1.5, creatinine - 1.5).otherwise(0.0)
    terms = [
        b["age"] * (age - 40) + F.when(age > 50, b["age_over_50"] * (age - 50)).when(age < 18, b["age_under_18"] * (age - 18)).otherwise(0.0),
        b["height"] * (c("height") - 170) / 10,
        F.when(weight < 80, b["weight"] * (weight - 80) / 5).when(weight.isNotNull(), 0.0),
        F.when(c("htn").isNull(), b["hypertension"] * c("htn_scale")).when(c("htn") == 1, b["hypertension"]).otherwise(0.0),
        F.when(c("diab").isNull() | (c("diab") == 998), b["diabetes"] * c("diab_scale")).when(c("diab") == 1, 0.0).when(c("diab").isin(2, 3, 4, 5), b["diabetes"]),
        F.when(c("cod") == 2, b["stroke"]).when(c("cod").isNotNull(), 0.0),
        F.when(creatinine.isNull(), 0.0).otherwise(b["creatinine"] * (creatinine - 1) + b["creatinine_over"] * over),
        F.when(c("dcd") == "Y", b["dcd"]).when(c("dcd") == "", F.lit(None).cast("double")).otherwise(0.0),
    ]
    if "race" in b:
        terms.append(F.when(c("race") == "BLACK", b["race"]).when(c("race") == "", F.lit(None).cast("double")).otherwise(0.0))
    if "hcv" in b:
        terms.append(F.when((c("anti_hcv") == "P") | (c("hcv_nat") == "P") | (c("hcv_stat") == 1), b["hcv"]).otherwise(0.0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def risk_score(donors: DataFrame, scales: DataFrame) -> DataFrame:
    """Adds risk (relative to a reference donor) and scaled risk; scales: year, htn_scale, diab_scale, risk_scale."""
    year = F.col("year")
    rows = donors.join(scales, "year", "left")
    risk = F.when(year.between(*EARLIER_YEARS), F.exp(log_risk(EARLIER))).when(year.between(*LATER_YEARS), F.exp(log_risk(LATER)))
    return rows.withColumn("risk", risk).withColumn("scaled_risk", F.col("risk") / F.col("risk_scale"))


def threshold_rank(df: DataFrame, bounds: DataFrame, value: str, key: str, array: str, name: str) -> DataFrame:
    """How many of a key's ascending bounds lie below a positive value; one past the last stays as it is."""
    joined = df.join(bounds, key, "left")
    below = F.size(F.filter(F.col(array), lambda b: b < F.col(value)))
    return joined.withColumn(name, F.when((F.col(value) > 0) & F.col(array).isNotNull(), below)).drop(array)
