"""Technology, trade and demand types: configured records, checked and turned into tables."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.errors import DataError
from regionflow.functions.config import config_frame

c = F.col

YEARS = "array<struct<year:int,value:double>>"
TYPE_SCHEMA = (
    "ord int, kind string, name string, commodity_in string, commodity_out string, "
    "commodity_out_2 string, efficiency double, loss double, technical_lifetime int, "
    "opex_cost_energy double, opex_cost_power double, capex_cost_power double, "
    "capex_cost_base double, capex_per_km double, distance_threshold_m double, "
    f"max_capacity_per_unit double, max_capacity {YEARS}, streets array<string>, "
    "availability_profile string, output_profile string, lifetime_existing double")

# The fields each kind must have; all others of the type table must be empty.
_COMMON = ["commodity_in", "commodity_out", "efficiency", "technical_lifetime"]
_POWER = ["opex_cost_energy", "opex_cost_power", "capex_cost_power"]
REQUIRED = {
    "decentral": _COMMON + _POWER,
    "central": _COMMON + _POWER + ["capex_cost_base"],
    "chp": _COMMON + _POWER + ["capex_cost_base", "commodity_out_2", "loss"],
    "grid": _COMMON + ["capex_per_km"],
    "pipe": _COMMON + ["capex_per_km", "distance_threshold_m"],
}
_CENTRAL_OPTIONAL = ["max_capacity_per_unit", "max_capacity", "streets", "availability_profile",
                     "output_profile", "lifetime_existing"]
OPTIONAL = {"decentral": ["lifetime_existing"], "central": _CENTRAL_OPTIONAL, "chp": _CENTRAL_OPTIONAL,
            "grid": ["lifetime_existing"], "pipe": ["lifetime_existing"]}
#: A CHP is also a central technology.
SUB_KINDS = {"decentral": ["decentral"], "central": ["central", "chp"], "chp": ["chp"],
             "grid": ["grid"], "pipe": ["pipe"]}


def year_values(value) -> list[tuple[int | None, float | None]] | None:
    """A number or ``{year: value}`` as year rows; a number is one row without a year."""
    if value is None:
        return None
    if isinstance(value, dict):
        return [(int(y), None if v is None else float(v)) for y, v in sorted(value.items())]
    return [(None, float(value))]


def type_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Technology type records (dicts with the type table's field names) as the type table."""
    names = [f.split()[0] for f in TYPE_SCHEMA.replace(YEARS, "years").split(", ")]
    rows = []
    for order, record in enumerate(records):
        unknown = set(record) - set(names)
        if unknown:
            raise DataError(f"type {record.get('name')}: unknown fields {sorted(unknown)}")
        values = dict(record, ord=order, max_capacity=year_values(record.get("max_capacity")))
        for name in names:
            if isinstance(values.get(name), int) and name not in ("ord", "technical_lifetime"):
                values[name] = float(values[name])
        rows.append(tuple(values.get(n) for n in names))
    return config_frame(spark, rows, TYPE_SCHEMA)


def catalog_violations(types: DataFrame) -> DataFrame:
    """``name, rule`` for every broken rule: unique names per kind, positive efficiency, required
    and forbidden fields."""
    every = sorted({f for fields in REQUIRED.values() for f in fields}
                   | {f for fields in OPTIONAL.values() for f in fields})
    rules = [F.when(~c("kind").isin(*REQUIRED), "unknown kind"),
             F.when(~(c("efficiency") > 0), "efficiency must be positive")]
    for kind, required in REQUIRED.items():
        here = c("kind") == kind
        rules += [F.when(here & c(f).isNull(), f"{f} is required") for f in required]
        rules += [F.when(here & c(f).isNotNull(), f"{f} is not allowed")
                  for f in every if f not in required + OPTIONAL[kind]]
    found = types.select("name", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
    twice = (types.groupBy("kind", "name").count().filter("count > 1")
             .select("name", F.lit("name is not unique").alias("rule")))
    return found.unionByName(twice)


def check_catalog(types: DataFrame) -> DataFrame:
    bad = catalog_violations(types).limit(20).collect()
    if bad:
        raise DataError("technology types: " + "; ".join(f"{r.name}: {r.rule}" for r in bad))
    return types


def match_types(types: DataFrame, kind: str, attribute: str | None = None, value=None) -> DataFrame:
    """Types of a kind and its sub-kinds, optionally with one attribute value, in catalogue order."""
    rows = types.filter(c("kind").isin(*SUB_KINDS[kind]))
    if attribute is not None:
        rows = rows.filter(c(attribute).eqNullSafe(F.lit(value)))
    return rows.orderBy(F.array_position(F.array(*[F.lit(k) for k in SUB_KINDS[kind]]), c("kind")), "ord")


# --- trade -----------------------------------------------------------------------------------------

TRADE_SCHEMA = ("ord int, kind string, commodity string, "
                f"price {YEARS}, co2 {YEARS}, max_cap {YEARS}, max_energy {YEARS}")


def trade_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Imports and exports: ``kind`` Import / Export, ``commodity`` and year-dependent fields."""
    rows = []
    for order, record in enumerate(records):
        if record["kind"] not in ("Import", "Export"):
            raise DataError(f"trade kind {record['kind']!r}")
        series = {f: year_values(record.get(f)) for f in ("price", "co2", "max_cap", "max_energy")}
        if series["price"] is None:
            raise DataError(f"{record['kind']} of {record['commodity']}: a price is required")
        late = [y for values in series.values() for y, _ in values or [] if y is not None and y > 100]
        if late:
            raise DataError(f"year {late[0]} > 100: years count from the model start")
        rows.append((order, record["kind"], record["commodity"], *series.values()))
    return config_frame(spark, rows, TRADE_SCHEMA)


# --- demand types and the scenario -------------------------------------------------------------------

@dataclass(frozen=True)
class DemandType:
    name: str
    commodity_in: str
    cooperation: bool
    yearly_decrease: float
    value_key: str | None = None
    profile_key: str | None = None
    shares_key: str | None = None
    shares_params: dict = field(default_factory=dict)
    default_supply: str | list[tuple[str, float]] | None = None
    value_params: dict = field(default_factory=dict)
    profile_params: dict = field(default_factory=dict)

    def default_mix(self) -> list[tuple[str, float]]:
        """Default technologies and shares; a list must not be empty and must sum to one."""
        if self.default_supply is None:
            return []
        if isinstance(self.default_supply, str):
            return [(self.default_supply, 1.0)]
        total = sum(share for _, share in self.default_supply)
        if not self.default_supply or abs(total - 1.0) > 1e-9 * max(abs(total), 1.0):
            raise DataError(f"demand {self.name}: default shares sum to {total}, must be 1")
        return [(name, float(share)) for name, share in self.default_supply]


def default_mix(spark: SparkSession, demand_types: list[DemandType]) -> DataFrame:
    """``demand, technology, share`` of every configured default."""
    rows = [(d.name, name, share) for d in demand_types for name, share in d.default_mix()]
    return config_frame(spark, rows, "demand string, technology string, share double")


def demand_type_frame(spark: SparkSession, demand_types: list[DemandType]) -> DataFrame:
    rows = [(i, d.name, d.commodity_in, d.cooperation, d.yearly_decrease) for i, d in enumerate(demand_types)]
    return config_frame(spark, rows, "demand_ord int, demand string, commodity string, "
                                     "cooperation boolean, yearly_decrease double")


@dataclass(frozen=True)
class Scenario:
    name: str
    start_year: int
    end_year: int
    year_gap: int
    dt_hours: int
    tss: str
    co2_price: float | dict | None = None
    co2_limit: float | dict | None = None
    discount_rate: float = 0.05

    @property
    def years(self) -> list[int]:
        return list(range(self.start_year, self.end_year + 1, self.year_gap))
