"""Energy and nutrient targets, and checks of week plans against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import safe_ratio, truthy

#: Activity factors and energy floors; energy of a kilogram of fat.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "very_active": 1.9}
KCAL_PER_KG = 7700.0
#: Bands of grams of protein per 100 kcal.
DENSITY = ((15.0, "anchor"), (8.0, "strong"), (4.0, "supporting"))


def _half_up(x: Column) -> Column:
    """Whole numbers, ties to even as the figures were published."""
    return F.bround(x)


def bmr(sex: Column, weight: Column, height: Column, age: Column) -> Column:
    """Mifflin; any sex but male takes the female constant."""
    return 10.0 * weight + 6.25 * height - 5.0 * age + F.when(sex == "male", 5.0).otherwise(-161.0)


def bmr_lean(lean: Column) -> Column:
    return 370.0 + 21.6 * lean


def plan_targets(people: DataFrame) -> DataFrame:
    """``people``: id, age, sex, height_cm, weight_kg, body_fat_pct, activity, goal_kg, pregnant. Adds bmi, bmr,
    tdee, target, protein, fat, carbs, fibre, water, weeks and stops. Any stop nulls all targets."""
    c = F.col
    metres = c("height_cm") / 100.0
    out = people.withColumns({"bmi": safe_ratio(c("weight_kg"), metres * metres), "lean": F.when(truthy("body_fat_pct"), c("weight_kg") * (1.0 - c("body_fat_pct") / 100.0)), "goal_bmi": safe_ratio(c("goal_kg"), metres * metres)})
    out = out.withColumn("bmr", F.when(c("lean").isNotNull(), bmr_lean(c("lean"))).otherwise(bmr(c("sex"), c("weight_kg"), c("height_cm"), c("age"))))
    factor = F.lit(None).cast("double")
    for name, f in ACTIVITY.items():
        factor = F.when(c("activity") == name, F.lit(f)).otherwise(factor)
    out = out.withColumn("tdee", c("bmr") * factor)
    stops = F.array_compact(F.array(F.when(c("age") < 18, "under age"), F.when(c("bmi") < 18.5, "underweight"), F.when(F.coalesce(c("pregnant"), F.lit(False)), "pregnancy"), F.when(c("goal_bmi") < 18.5, "goal underweight")))
    rate = F.when(c("bmi") < 22, 0.005).otherwise(0.0075)
    floor = F.when(c("sex") == "male", 1500.0).otherwise(1200.0)
    out = out.withColumns({"stops": stops, "weekly_kg": c("weight_kg") * rate, "deficit": F.least(c("weight_kg") * rate * KCAL_PER_KG / 7.0, 0.25 * c("tdee"))})
    out = out.withColumn("target", F.greatest(c("tdee") - c("deficit"), floor))
    healthy = 25.0 * metres * metres
    basis = F.when(c("lean").isNotNull(), 2.2 * c("lean")).when(c("bmi") >= 27, 2.0 * F.when(c("goal_kg") >= 0.9 * healthy, c("goal_kg")).otherwise(healthy)).otherwise(1.8 * c("weight_kg"))
    reference = F.coalesce(c("lean"), F.when(c("bmi") >= 27, F.when(c("goal_kg") >= 0.9 * healthy, c("goal_kg")).otherwise(healthy)).otherwise(c("weight_kg")))
    out = out.withColumn("protein", _half_up(F.least(basis, 0.45 * c("target") / 4.0)))
    out = out.withColumn("fat", _half_up(F.greatest(0.6 * reference, 0.20 * c("target") / 9.0)))
    out = out.withColumn("carbs", _half_up((c("target") - 4.0 * c("protein") - 9.0 * c("fat")) / 4.0))
    out = out.withColumns({
        "fibre": F.least(_half_up(14.0 * c("target") / 1000.0), F.lit(40.0)), "water": _half_up(35.0 * c("weight_kg") / 100.0) * 100.0,
        "weeks": F.when((c("goal_kg") < c("weight_kg")) & (c("deficit") > 0), safe_ratio(c("weight_kg") - c("goal_kg"), F.least(c("weekly_kg"), (c("tdee") - c("target")) * 7.0 / KCAL_PER_KG))),
    })
    targets = ("target", "protein", "fat", "carbs", "fibre", "water", "weeks")
    return out.withColumns({t: F.when(F.size("stops") == 0, c(t)) for t in targets})


def day_totals(items: DataFrame) -> DataFrame:
    """``items``: plan, day, meal, food, kcal, protein, fibre. Totals by meal, then by day: sums over what is
    given, zero where nothing is. Sums are of decimals, so their order is no matter."""
    d = lambda x: F.coalesce(F.sum(F.col(x).cast("decimal(18,4)")).cast("double"), F.lit(0.0))
    meals = items.groupBy("plan", "day", "meal").agg(d("kcal").alias("kcal"), d("protein").alias("protein"), d("fibre").alias("fibre"))
    return meals.groupBy("plan", "day").agg(
        d("kcal").alias("kcal"), d("protein").alias("protein"), d("fibre").alias("fibre"), F.count(F.lit(1)).alias("meals"),
        F.count_if(F.col("protein") >= 20).alias("protein_meals"), F.coalesce(F.max("protein"), F.lit(0.0)).alias("largest_meal"),
    )


def check_days(days: DataFrame, kcal: Column, protein: Column, fibre: Column) -> DataFrame:
    """failures gate the plan; notices don't. A target of zero or null skips its check."""
    c = F.col
    failures = F.array_compact(F.array(
        F.when(truthy(kcal) & (F.abs(c("kcal") - kcal) > 0.10 * kcal), "energy"), F.when(truthy(protein) & (c("protein") < protein - 0.5), "protein"),
    ))
    notices = F.array_compact(F.array(
        F.when(c("protein_meals") < 3, "protein spread"), F.when(truthy(fibre) & (c("fibre") > 0) & (c("fibre") < 0.8 * fibre), "fibre"), F.when(c("meals") < 3, "meals"),
    ))
    return days.withColumns({"failures": failures, "notices": notices})


def check_week(items: DataFrame) -> DataFrame:
    """plan, days, foods (distinct first parts of food names) and notices on both."""
    food = F.lower(F.trim(F.substring_index("food", ",", 1)))
    out = items.groupBy("plan").agg(F.countDistinct("day").alias("days"), F.countDistinct(food).alias("foods"))
    notices = F.array_compact(F.array(F.when(F.col("days") != 7, "week size"), F.when((F.col("foods") > 22) | ((F.col("foods") > 0) & (F.col("foods") < 8)), "variety")))
    return out.withColumn("notices", notices)


def protein_density(protein: Column, kcal: Column) -> Column:
    return F.try_divide(protein * 100.0, F.nullif(kcal, F.lit(0.0)))


def density_band(density: Column) -> Column:
    out = F.when(density.isNull(), F.lit(None).cast("string"))
    for bound, name in DENSITY:
        out = out.when(density >= bound, name)
    return out.otherwise("garnish")


def fat_from_deficit(maintenance: Column, intake: Column, days: Column) -> Column:
    return (maintenance - intake) * days / KCAL_PER_KG


def shopping_list(items: DataFrame, people: float = 1.0) -> DataFrame:
    """section, food and quantity for a household."""
    return items.groupBy("section", "food").agg((F.sum(F.col("qty").cast("decimal(18,4)")).cast("double") * people).alias("qty"))


def swap_portion(protein_per_gram: Column, block: float = 25.0) -> Column:
    return F.try_divide(F.lit(block), F.nullif(protein_per_gram, F.lit(0.0)))


def fallback_meals(meals: DataFrame) -> DataFrame:
    return meals.filter((F.col("minutes") <= 10) & (F.col("protein") >= 30))
