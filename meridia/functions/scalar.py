"""Column builders: null-strict scalar rules.  A missing value stays missing; nothing is filled in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

COMPLETE = 1e-6  # slack of a full coverage
#: Kilograms in a pound and a short ton, square kilometres in an acre.
LB_TO_KG = 0.45359237
SHORT_TON_KG = 907.18474
ACRE_KM2 = 0.0040468564224


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    return F.lit(float(x))


def finite(x: C) -> Column:
    """NaN and infinities become null."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < num("inf")), x)


def rounded(x: C, digits: int) -> Column:
    """Rounded as DuckDB does: the product with a power of ten, halves away from zero.  Spark's `round` takes the shortest decimal text."""
    x, power = col(x), num(10.0**digits)
    y = F.abs(x) * power
    whole = F.floor(y).cast("double")
    return F.when(y < num(2.0**52), F.signum(x) * (whole + F.when(y - whole >= num(0.5), num(1)).otherwise(num(0))) / power).when(y < num("inf"), x * power / power).otherwise(x)


def normalise(x: C, low: float, high: float, direction: str = "minimise") -> Column:
    """Clip to [low, high] and scale to 0..100; 100 is best."""
    if not low < high:
        raise ValueError("the lower reference must be below the upper one")
    x = finite(x)
    part = 100.0 * (F.least(F.greatest(x, num(low)), num(high)) - low) / (high - low)
    return F.when(x.isNotNull(), 100.0 - part if direction == "minimise" else part)


def normalise_status(x: C, low: float, high: float) -> Column:
    x = finite(x)
    return F.when(x.isNull(), "missing").when(x < low, "clipped_low").when(x > high, "clipped_high").otherwise("within")


def annual_physics(mw: C, load: C, hours: C, pue: C, kg_per_mwh: C, wue: C) -> dict[str, Column]:
    """Energy, emissions and site water of a year; a factor that is unknown leaves its product unknown."""
    e_it = col(mw) * col(load) * col(hours)
    e_fac = e_it * col(pue)
    kg = e_fac * col(kg_per_mwh)
    litres = e_it * 1000.0 * col(wue)
    return {"e_it_mwh": e_it, "e_fac_mwh": e_fac, "carbon_kg": kg, "carbon_t": kg / 1000.0, "water_l": litres, "water_m3": litres / 1000.0}


def route_water(basis: C, value: C) -> dict[str, Column]:
    """A withdrawal is no consumption: it moves to its own column."""
    withdrawn = col(basis) == "withdrawal"
    return {"water_withdrawal_m3": F.when(withdrawn, col(value)), "water_consumption_m3": F.when(~withdrawn, col(value))}


def gated(value: C, coverage: C, status: C, least: float = 1 - COMPLETE) -> Column:
    """The value where its coverage is complete and its status known."""
    return F.when((col(coverage) >= least) & (col(status) != "unknown"), col(value))


def county_accounting(mw: C, load: C, hours: C, pue: C, wue: C, usd_per_mwh: C, kg_per_mwh: C, basis: str = "it", indirect_l_per_kwh: C | None = None) -> dict[str, Column]:
    out = annual_physics(mw, load, hours, pue, kg_per_mwh, wue)
    site = out["e_it_mwh"] if basis == "it" else out["e_fac_mwh"]
    made = {
        "e_it_mwh": out["e_it_mwh"],
        "e_fac_mwh": out["e_fac_mwh"],
        "electricity_usd": out["e_fac_mwh"] * col(usd_per_mwh),
        "carbon_t": out["carbon_t"],
        "site_water_m3": site * col(wue),
    }
    if indirect_l_per_kwh is not None:
        made["indirect_water_m3"] = out["e_fac_mwh"] * col(indirect_l_per_kwh)
    return made


CONVERSIONS = {
    "cents_per_kwh_to_usd_per_mwh": lambda x: col(x) * 10.0,
    "lb_to_kg": lambda x: col(x) * LB_TO_KG,
    "fahrenheit_to_celsius": lambda x: (col(x) - 32.0) * 5.0 / 9.0,
    "kelvin_to_celsius": lambda x: col(x) - 273.15,
    "kg_m2_s_to_mm_day": lambda x: col(x) * 86400.0,
    "percent_to_fraction": lambda x: col(x) / 100.0,
}


def evidence(value: C, base_status: C, is_proxy: C, coverage: C) -> dict[str, Column]:
    """Status, confidence and missing reason of a value."""
    have = col(value).isNotNull()
    confidence = F.when(~have, F.lit(None)).when(col(is_proxy), "low").when(col(coverage) < 0.95, "low").when(col(coverage) == 1.0, "high").otherwise("medium")
    return {"status": F.when(have, col(base_status)).otherwise("unknown"), "confidence": confidence, "missing_reason": F.when(~have, "source_value_missing")}


def sentinel(x: C, missing: float = -9999.0, extreme: float = 9999.0) -> dict[str, Column]:
    """A missing code is null; an extreme code is a flag and stays out of means."""
    x = col(x)
    return {"value": F.when((x != missing) & (x != extreme), x), "is_extreme": F.when(x != missing, x == extreme)}


def positive(x: C) -> Column:
    return F.when(col(x) > 0, col(x))


#: Tokens that stand for a missing number.
MISSING_NUMBERS = ["", ".", "-", "--", "*", "**", "d", "n/a", "na", "null", "none"]


def lenient_number(x: C) -> Column:
    """A number; null for missing tokens and negative values; anything else is an error (ANSI cast)."""
    bare = F.regexp_replace(F.trim(col(x)), ",", "")
    number = F.when(~F.lower(bare).isin(MISSING_NUMBERS), bare).cast("double")
    return F.when(number >= 0, number)


def clean_text(x: C, unknown: Sequence[str] = ("", "unknown", "n/a", "none", "tbd")) -> Column:
    """White space collapsed; null for words that mean unknown."""
    bare = F.trim(F.regexp_replace(col(x), r"\s+", " "))
    return F.when(~F.lower(bare).isin(list(unknown)), bare)


def capacity_mw(x: C) -> Column:
    return F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(col(x), r"([\d,.]+)\s*MW", 1), ",", ""), F.lit("")), F.lit("999999999.999")).cast("double")


def first_year(x: C) -> Column:
    return F.nullif(F.regexp_extract(col(x), r"(\d{4})", 1), F.lit("")).cast("int")


def before_last_comma(x: C) -> Column:
    """The text before the last comma, or null when there is none."""
    x = col(x)
    return F.when(F.instr(x, ",") > 0, F.trim(F.regexp_replace(x, ",[^,]*$", "")))


def after_last_comma(x: C) -> Column:
    return F.trim(F.substring_index(col(x), ",", -1))


def label_value(x: C) -> Column:
    parts = F.split(col(x), ":", 2)
    return F.struct(F.trim(parts[0]).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def county_key(x: C) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(x))), r" +(county|parish|borough|census[ -]area)$", "")


def zero_padded(x: C, width: int) -> Column:
    return F.lpad(F.regexp_replace(col(x).cast("string"), r"\.0$", ""), width, "0")


def is_code(x: C, digits: int) -> Column:
    return F.coalesce(col(x).rlike(f"^[0-9]{{{digits}}}$"), F.lit(False))


def grid_id(row: C, column: C, size_m: int, prefix: str | None = None, width: int | None = None) -> Column:
    """Numbers of four digits or more; with `width`, of so many digits always: longer numbers keep their first, so ids may repeat."""
    head = f"{prefix}-" if prefix else ""
    if width:
        return F.concat(F.lit(f"{head}g{size_m}m-r"), zero_padded(row, width), F.lit("-c"), zero_padded(column, width))
    return F.format_string(f"{head}g{size_m}m-r%04d-c%04d", col(row), col(column))


def tile_id(row: C, column: C, n: int, width: int | None = None) -> Column:
    """As :func:`grid_id`."""
    tiles = [F.floor(col(x) / n).cast("int") for x in (row, column)]
    if width:
        return F.concat(F.lit(f"t{n}-tr"), zero_padded(tiles[0], width), F.lit("-tc"), zero_padded(tiles[1], width))
    return F.format_string(f"t{n}-tr%04d-tc%04d", *tiles)


def cell_of(x: C, y: C, ox: float, oy: float, size: float) -> dict[str, Column]:
    return {"grid_row": F.floor((num(oy) - col(y)) / size).cast("int"), "grid_col": F.floor((col(x) - ox) / size).cast("int")}


def cell_bounds(row: C, column: C, ox: float, oy: float, size: float) -> dict[str, Column]:
    x0, y1 = num(ox) + col(column) * size, num(oy) - col(row) * size
    return {"xmin": x0, "xmax": x0 + size, "ymin": y1 - size, "ymax": y1}


def cell_centre(row: C, column: C, ox: float, oy: float, size: float) -> dict[str, Column]:
    return {"x": num(ox) + (col(column) + 0.5) * size, "y": num(oy) - (col(row) + 0.5) * size}


def triangular(u: C, low: C, mode: C, high: C) -> Column:
    """Inverse distribution function; a prior without width is its mode."""
    low, mode, high, u = col(low), col(mode), col(high), col(u)
    span = high - low
    split = (mode - low) / span
    return F.when(span == 0, mode).when(u <= split, low + F.sqrt(u * span * (mode - low))).otherwise(high - F.sqrt((1 - u) * span * (high - mode)))


def compound(start: C, rate: C, year: C, base: int) -> Column:
    return col(start) * F.pow(1 + col(rate), col(year) - base)


def discounted(value: C, rate: C, year: C, base: int) -> Column:
    """End-of-year payment."""
    return col(value) / F.pow(1 + col(rate), col(year) - base + 1)


def main_driver(deltas: dict[str, C], floor: float = 1e-15) -> Column:
    """Name of the largest absolute change above `floor`; ties go to the smaller name."""
    ordered = F.array_sort(F.array(*[F.when(F.abs(col(v)) > floor, F.struct((-F.abs(col(v))).alias("d"), F.lit(k).alias("k"))) for k, v in sorted(deltas.items())]))
    return F.get(ordered, F.lit(0))["k"]


def rank_status(eligible: C, score: C, weights_ok: C, conditional: C) -> Column:
    return (
        F.when(~col(eligible), "INELIGIBLE").when(col(score).isNull(), "UNRANKED").when(~col(weights_ok), "WEIGHTS_REVIEW_REQUIRED").when(col(conditional), "CONDITIONAL").otherwise("RANKED")
    )


def display_status(hard_fail: C, conditional: C, critical_unknown: C) -> Column:
    return F.when(col(hard_fail), "FAIL").when(col(conditional), "CONDITIONAL").when(col(critical_unknown), "UNKNOWN").otherwise("PASS")


#: Which status stands for a cell when its rows differ.
CELL_ORDER = ["FAIL", "UNKNOWN", "CONDITIONAL", "PASS"]


def cell_status(status: C) -> Column:
    """Aggregate: the first of CELL_ORDER that occurs."""
    return F.min_by(col(status), F.array_position(F.array(*map(F.lit, CELL_ORDER)), col(status)))


def distance_class(km: C, near: float = 25.0, far: float = 50.0) -> Column:
    return F.when(col(km) <= near, "validated").when(col(km) > far, "emerging").when(col(km).isNotNull(), "unresolved")


def first_provider(scores: Sequence[C], reasons: Sequence[C]) -> dict[str, Column]:
    score = F.coalesce(*map(col, scores))
    return {"score": score, "reason": F.when(score.isNull(), F.concat_ws("; ", *map(col, reasons)))}


def smallest_threshold(rank: C, thresholds: Sequence[int]) -> Column:
    return F.array_min(F.filter(F.array(*map(F.lit, thresholds)), lambda n: n >= col(rank)))


def and_list(phrases: C) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    x = col(phrases)
    head = F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1))), ", ")
    return F.when(F.size(x) == 0, "").when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(x, -1)))


def explain(contributions: dict[str, C], strong: float, phrases: dict[str, str]) -> Column:
    """Phrases of the contributions above a threshold, largest first."""
    parts = F.array_sort(F.array_compact(F.array(*[F.when(col(v) >= strong, F.struct((-col(v)).alias("s"), F.lit(k).alias("k"), F.lit(phrases[k]).alias("p"))) for k, v in sorted(contributions.items())])))
    return and_list(F.transform(parts, lambda p: p["p"]))


def keyword_action(text: C, actions: Sequence[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for word, action in reversed(actions):
        out = F.when(F.lower(col(text)).contains(word), action).otherwise(out)
    return out


def paired_delta(a: C, b: C, a_reason: C, b_reason: C) -> dict[str, Column]:
    delta = col(a) - col(b)
    reasons = F.array_join(F.array_distinct(F.array_compact(F.array(F.when(col(a).isNull(), col(a_reason)), F.when(col(b).isNull(), col(b_reason))))), "; ")
    return {"delta": delta, "delta_reason": F.when(delta.isNull(), reasons)}


def heat_reuse(e_mwh: C, share: C, loss: C, demand_mwh: C, compatible: C) -> dict[str, Column]:
    """Heat that can be delivered; incompatible is 0, anything missing is null with its reasons."""
    possible = col(e_mwh) * col(share) * (1 - col(loss))
    known = possible.isNotNull() & col(demand_mwh).isNotNull() & col(compatible).isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(col(e_mwh).isNull(), "energy"), F.when(col(share).isNull(), "share"), F.when(col(loss).isNull(), "loss"), F.when(col(demand_mwh).isNull(), "demand"), F.when(col(compatible).isNull(), "compatibility")
        )
    )
    value = F.when(col(compatible) == F.lit(False), num(0)).when(known, F.least(possible, col(demand_mwh)))
    return {"reused_mwh": value, "reuse_missing": F.when(value.isNull(), F.array_join(reasons, ","))}


def freight_kg(mass_kg: C, km: C, kg_per_t_km: C) -> Column:
    return col(mass_kg) / 1000.0 * col(km) * col(kg_per_t_km)


def region_id(profile: C, design: C, scenario: C, members: C) -> Column:
    text = F.to_json(F.array(col(profile), col(design), col(scenario), F.array_join(F.array_sort(col(members)), ";")))
    return F.concat(F.lit("region_"), F.substring(F.sha2(text, 256), 1, 20))


def row_fingerprint(columns: Sequence[str]) -> Column:
    """Hash of a row's values, whatever the order of its columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def hashed_uniform(*parts: C) -> Column:
    """A uniform number in [0, 1) that any engine with SHA-256 can reproduce."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0
