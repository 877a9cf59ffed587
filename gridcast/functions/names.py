"""Sensor names to channel names, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw cooler names after cleaning -> channel names.
COOLER_CHANNELS = {
    "group_airflowmetric": "airflow_lps",
    "group_airflowus": "airflow_cfm",
    "group_cooloutput": "cool_output_kwh",
    "group_minrackinlettempmetric": "min_rack_inlet_c",
    "rdt2_cooldemand": "cool_demand_kwh",
    "rdt2_evaporatorfanspeed": "evap_fan_speed_pct",
    "rdt2_returnairtempmetric": "return_air_c",
    "rdt2_suctiontempmetric": "suction_c",
    "rdt2_supplyairtempmetric": "supply_air_c",
}
# Names that carry the status prefix after cleaning.
COOLER_STATUS_CHANNELS = {
    "group_status_airflowmetric": "airflow_lps",
    "group_status_airflowus_cubicfeet_m": "airflow_cfm",
    "group_status_cooloutput": "cool_output_kwh",
    "group_status_minrackinlettempmetric_c": "min_rack_inlet_c",
    "rdt2_status_cooldemand": "cool_demand_kwh",
    "rdt2_status_evaporatorfanspeed": "evap_fan_speed_pct",
    "rdt2_status_returnairtempmetric_c": "return_air_c",
    "rdt2_status_suctiontempmetric_c": "suction_c",
    "rdt2_status_supplyairtempmetric_c": "supply_air_c",
}
# Vendor prefixes and what replaces them.
COOLER_PREFIXES = {"airIRG2GroupStatus": "group_", "airIRG2RDT2Status": "rdt2_"}
# Features in order of preference, and name parts tried without them.
PREFERRED_FEATURES = (
    "airflow_lps",
    "cool_output_kwh",
    "cool_demand_kwh",
    "evap_fan_speed_pct",
    "return_air_c",
    "suction_c",
    "supply_air_c",
    "min_rack_inlet_c",
)
FEATURE_PATTERNS = (
    "airflow",
    "cool_output",
    "cool_demand",
    "fan_speed",
    "return_air",
    "suction",
    "supply_air",
    "min_rack_inlet",
)
# The label of the channel that is not plugged in, and its name.
UNUSED_LABEL = "Temperature (1)"
UNUSED_CHANNEL = "temp_unused_channel"

NON_WORD = r"(?U)[^\w]+"
SPACE = " \t\n\r\f\v"


def rename(c: Column, names: dict[str, str]) -> Column:
    """Look ``c`` up in a map; names that are not in it stay."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def clean_cooler_key(c: Column, final: bool = True) -> Column:
    """Cooler name to channel: drop ``[unit]``, shorten prefixes, snake case, rename.

    ``final=False`` stops before the second rename.
    """
    out = F.regexp_replace(c, r"\[.*?\]", "")
    for prefix, short in COOLER_PREFIXES.items():
        out = F.replace(out, F.lit(prefix), F.lit(short))
    out = F.replace(out, F.lit("/"), F.lit("_per_"))
    out = F.lower(F.btrim(F.regexp_replace(out, NON_WORD, "_"), F.lit("_")))
    out = rename(out, COOLER_STATUS_CHANNELS)
    return rename(out, COOLER_CHANNELS) if final else out


def clean_probe_label(c: Column) -> Column:
    """``Temperature (Cabin 3 - Back - 24U)`` -> ``temp_cabin3_back_24u_c``.

    Missing parts become ``pos?`` and ``u?``, whose marks turn into ``_``; labels
    of another shape are lower-cased and snake-cased.
    """
    return _let(F.btrim(c, F.lit(SPACE)), _clean_trimmed_label)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside array lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clean_trimmed_label(k: Column) -> Column:
    shape = r"^Temperature\s*\((.*?)\)"

    def placed(parts: Column) -> Column:
        cabin = F.regexp_replace(F.get(parts, F.lit(0)), r"\s+", "")
        pos = F.coalesce(F.btrim(F.get(parts, F.lit(1)), F.lit(SPACE)), F.lit("pos?"))
        height = F.coalesce(F.btrim(F.get(parts, F.lit(2)), F.lit(SPACE)), F.lit("u?"))
        name = F.concat(F.lit("temp_"), cabin, F.lit("_"), pos, F.lit("_"), height, F.lit("_c"))
        return F.regexp_replace(name, NON_WORD, "_")

    other = F.replace(F.lower(k), F.lit("temperature"), F.lit("temp"))
    return (
        F.when(k == UNUSED_LABEL, UNUSED_CHANNEL)
        .when(
            k.startswith("Temperature") & F.regexp_like(k, F.lit(shape)),
            _let(F.split(F.lower(F.regexp_extract(k, shape, 1)), "-"), placed),
        )
        .otherwise(F.regexp_replace(other, NON_WORD, "_"))
    )


def height_u(c: Column) -> Column:
    """Rack height in a channel name, ``..._24u_...`` -> 24, else NULL."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"_(\d{1,2})u_", 1), F.lit("")), F.lit("99")).cast("int")
