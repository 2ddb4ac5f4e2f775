"""Physical units and the unit table of the model input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.config import config_frame

# Unit -> (dimension, size in W or Wh).
UNITS = {
    "kW": ("power", 1e3), "MW": ("power", 1e6), "GW": ("power", 1e9),
    "kWh": ("energy", 1e3), "MWh": ("energy", 1e6), "GWh": ("energy", 1e9), "TWh": ("energy", 1e12),
}

# Labels of the seven quantities when a system is given in kW, MW or GW.
SYSTEM_LABELS = {
    "kW": {"power": "kW", "energy": "MWh", "co2_emissions": "t", "cost_energy": "EUR/MWh",
           "cost_power": "EUR/kW", "co2_spec": "kg/kWh", "money": "EUR"},
    "MW": {"power": "MW", "energy": "GWh", "co2_emissions": "kilo t", "cost_energy": "EUR/MWh",
           "cost_power": "EUR/kW", "co2_spec": "kg/kWh", "money": "k EUR"},
    "GW": {"power": "GW", "energy": "TWh", "co2_emissions": "Mio t", "cost_energy": "EUR/MWh",
           "cost_power": "EUR/kW", "co2_spec": "kg/kWh", "money": "Mio EUR"},
}

# Quantity, input unit, factor, stored unit of the model-input tables.
MODEL_UNITS = {
    "kW": [("power", "kW", 1.0, "kW"), ("energy", "MWh", 1000.0, "kWh"), ("co2_emissions", "t", 1.0, "t"),
           ("cost_energy", "EUR/MWh", 0.001, "EUR/kWh"), ("cost_power", "EUR/kW", 1.0, "EUR/kW"),
           ("co2_spec", "kg/kWh", 0.001, "t/kWh"), ("money", "EUR", 1.0, "EUR")],
    "MW": [("power", "MW", 1.0, "MW"), ("energy", "GWh", 1000.0, "MWh"), ("co2_emissions", "t", 1.0, "t"),
           ("cost_energy", "EUR/MWh", 0.001, "k EUR/MWh"), ("cost_power", "EUR/kW", 1.0, "k EUR/MW"),
           ("co2_spec", "t/MWh", 1.0, "t/MWh"), ("money", "k EUR", 1.0, "k EUR")],
    "GW": [("power", "GW", 1.0, "GW"), ("energy", "TWh", 1000.0, "GWh"), ("co2_emissions", "Mio t", 1.0, "Mio t"),
           ("cost_energy", "EUR/MWh", 0.001, "Mio EUR/GWh"), ("cost_power", "EUR/kW", 1.0, "Mio EUR/GW"),
           ("co2_spec", "kg/kWh", 0.001, "Mio t/GWh"), ("money", "Mio EUR", 1.0, "Mio EUR")],
}

#: Model tables are written in MW terms from kW data: MWh to GWh, EUR to k EUR, kW to MW.
MODEL_SCALE = 0.001


def conversion_factor(source: str, target: str) -> float:
    for unit in (source, target):
        if unit not in UNITS:
            raise DataError(f"unknown unit {unit!r}")
    if UNITS[source][0] != UNITS[target][0]:
        raise DataError(f"cannot convert {source} to {target}")
    return UNITS[source][1] / UNITS[target][1]


def convert_unit(rows: DataFrame, column: str, source, target: str) -> DataFrame:
    """Convert ``column`` to ``target``; ``source`` is a unit name, a unit column, or None.

    NULL values stay NULL; a missing unit or another dimension is an error.
    """
    if source is None:
        raise DataError(f"{column} has no unit, but {target} is requested")
    if isinstance(source, str):
        return rows.withColumn(column, F.col(column) * F.lit(conversion_factor(source, target)))
    factors = F.create_map(*[F.lit(v) for unit, (dimension, size) in UNITS.items()
                             if dimension == UNITS[target][0]
                             for v in (unit, size / UNITS[target][1])])
    factor = F.element_at(factors, source)
    problem = F.concat(F.lit("cannot convert "), F.coalesce(source.cast("string"), F.lit("no unit")),
                       F.lit(f" to {target}"))
    return rows.withColumn(column, F.when(F.col(column).isNull(), F.lit(None).cast("double"))
                           .when(factor.isNull(), F.raise_error(problem).cast("double"))
                           .otherwise(F.col(column) * factor))


def model_units(spark: SparkSession, system: str) -> DataFrame:
    if system not in MODEL_UNITS:
        raise DataError(f"unsupported system unit {system!r}")
    return config_frame(spark, MODEL_UNITS[system],
                        "quantity string, input string, scale_factor double, output string")


def result_factors(system: str) -> dict[str, float]:
    """Divisors that bring solver results back to the system's units."""
    factors = {quantity: factor for quantity, _, factor, _ in MODEL_UNITS[system]}
    return {"power": factors["power"] * MODEL_SCALE, "energy": factors["energy"] * MODEL_SCALE,
            "money": factors["money"] * MODEL_SCALE, "co2_emissions": factors["co2_emissions"]}
