"""Common names of metadata headers and of gridded variables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Standard names of site and plant metadata with the headers they go by (fixed values).
SITE = {
    "si_code": ["site code", "site id", "site"],
    "si_name": ["site name", "name of site"],
    "si_lat": ["latitude", "lat", "site latitude"],
    "si_long": ["longitude", "lon", "long", "site longitude"],
    "si_elev": ["elevation", "elevation m", "altitude", "elev"],
    "si_igbp": ["igbp", "igbp class", "land cover"],
}
PLANT = {
    "pl_code": ["plant code", "tree id", "plant id", "tree"],
    "pl_species": ["species", "species name"],
    "pl_dbh": ["dbh", "diameter at breast height", "dbh cm"],
    "pl_sapw_area": ["sapwood area", "sapwood area cm2"],
    "pl_height": ["height", "tree height", "height m"],
}
# Short names of reanalysis variables and coordinates (fixed values).
SHORT = {
    "t2m": "2m_temperature", "d2m": "2m_dewpoint_temperature", "ssrd": "surface_solar_radiation_downwards", "strd": "surface_thermal_radiation_downwards", "tp": "total_precipitation", "u10": "10m_u_component_of_wind",
    "v10": "10m_v_component_of_wind", "sp": "surface_pressure", "skt": "skin_temperature", "swvl1": "volumetric_soil_water_layer_1", "stl1": "soil_temperature_level_1", "pev": "potential_evaporation",
}
COORDINATES = {"lat": "latitude", "lon": "longitude", "valid_time": "time"}
#: Dimensions that carry no data of their own: of versions the last counts, of members and steps the first.
LAST, FIRST = ("expver",), ("number", "step")


def _plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def standard_header(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to the standard names whose headers they match, in any case and with any marks between words. A standard column that is
    there stays, of several matches the vocabulary's first alias wins and the others keep their names; columns without a match stay."""
    by: dict[str, str] = {}
    for c in df.columns:
        by.setdefault(_plain(c), c)
    rename = {}
    for name, aliases in vocabulary.items():
        if name not in df.columns and (found := next((by[_plain(a)] for a in aliases if _plain(a) in by and by[_plain(a)] not in rename), None)):
            rename[found] = name
    return df.withColumnsRenamed(rename)


def standard_grid(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A gridded table with common names of coordinates and variables, and without nuisance dimensions: rows of the last ``expver`` and of the first
    ``number`` and ``step`` stay, each over the whole table, and the columns go. A name that is taken is not given again."""
    dims = [c for c in (*LAST, *FIRST) if c in df.columns]
    if dims:
        ends = df.agg(*((F.max if c in LAST else F.min)(c).alias(f"_{c}") for c in dims))
        df = df.join(F.broadcast(ends))  # one row
        for c in dims:
            df = df.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
        df = df.drop(*dims, *(f"_{c}" for c in dims))
    lower = {c.lower(): c for c in df.columns}
    rename = {lower[k]: v for k, v in ((names or SHORT) | COORDINATES).items() if k in lower and v not in df.columns}
    return df.withColumnsRenamed(rename)
