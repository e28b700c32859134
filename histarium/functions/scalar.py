"""Column expressions on cells, channels and acquisitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last token of a channel name that looks like an isotope: symbol and mass, either way round.
ISOTOPE = r"^.*(?<![A-Za-z])([A-Z][a-z]?)(\d{2,3})(?!\d)"
ISOTOPE_REVERSED = r"^.*(?<!\d)(\d{2,3})([A-Z][a-z]?)(?![a-z])"
#: Synonyms of markers. Fixed values.
SYNONYMS = {"PD1": "PDCD1", "PDL1": "CD274", "Ki67": "MKI67", "SMA": "ACTA2"}
PIXEL_SIZE_KEYS = ("pixel_size_x", "pixel_size", "PhysicalSizeX")
NAME_ENDS = r"(\.ome\.tiff?|\.tiff?|\.mcd)$"


def channel_name(metal: Column, label: Column, index: Column) -> Column:
    """``label_metal``, else label, else metal, else ``Channel_i``; blanks count as missing."""
    m, n = (F.when(F.trim(c) != "", F.trim(c)) for c in (metal, label))
    return F.coalesce(F.when(m.isNotNull() & n.isNotNull(), F.concat_ws("_", n, m)), n, m, F.concat(F.lit("Channel_"), index.cast("string")))


def unique_acquisition(acq_id: Column, path: Column) -> Column:
    """An id that stays unique when files are merged."""
    return F.concat(acq_id, F.lit("__file_"), F.substring(F.md5(path), 1, 8))


def arcsinh(value: Column, cofactor: float = 10.0) -> Column:
    if cofactor <= 0:
        raise ValueError("cofactor must be positive")
    return F.asinh(value / cofactor)


def source_well(file: Column, well: Column) -> Column:
    """File name without its image ending, and the well if there is one."""
    return F.concat_ws("_", F.regexp_replace(file, f"(?i){NAME_ENDS}", ""), F.when(well != "", well))


def isotope_mass(name: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(name, ISOTOPE, 2), F.lit("")), F.nullif(F.regexp_extract(name, ISOTOPE_REVERSED, 1), F.lit("")))
    return found.cast("int")


def isotope_metal(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, ISOTOPE, 1), F.lit("")), F.nullif(F.regexp_extract(name, ISOTOPE_REVERSED, 2), F.lit("")))


def marker_name(feature: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Feature name without what follows its last underscore; synonyms renamed."""
    known = SYNONYMS if synonyms is None else synonyms
    name = F.regexp_replace(feature, "_[^_]*$", "")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    return F.coalesce(F.element_at(table, name), name) if known else name


def pixel_size(metadata: Column) -> Column:
    """The first usable size among the metadata's known keys, else 1."""
    return F.coalesce(*[F.element_at(metadata, k).try_cast("double") for k in PIXEL_SIZE_KEYS], F.lit(1.0))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def composition_key(file: Column, acq_id: Column) -> Column:
    return F.concat_ws("_", file, acq_id)


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def to_um(pixels: Column, pixel_size_um: Column | float) -> Column:
    """A length or place in micrometres."""
    return pixels * pixel_size_um
