"""Roles of columns, told from their names: ids, intensities, shapes, others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Column names by role. Fixed values.
STATISTICS = ["mean", "median", "std", "mad", "p10", "p90", "integrated", "frac_pos"]
MORPHOLOGY = [
    "area_um2", "perimeter_um", "equivalent_diameter_um", "eccentricity", "solidity", "extent", "circularity",
    "major_axis_len_um", "minor_axis_len_um", "aspect_ratio", "bbox_area_um2", "touches_border", "holes_count",
]
IDS = [
    "cell_id", "label", "acquisition_id", "acquisition_name", "acquisition_label", "roi_id", "roi", "well", "source_file",
    "source_well", "cluster", "cluster_id", "cluster_phenotype", "manual_phenotype", "spatial_community", "batch_group",
]
CENTROIDS = ["centroid_x", "centroid_y"]
ROI_KEYS, BATCH_KEYS = ["acquisition_id", "roi_id", "roi"], ["source_file", "acquisition_id"]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: What each rule of ``feature_columns`` leaves out. Fixed values.
NOT_CLUSTERED = ["label", "acquisition_id", "acquisition_name", "acquisition_label", "well", "cluster", "cell_id", "source_file", "source_well"]
NOT_PLOTTED = ["cluster", "__group__", "cluster_phenotype", "manual_phenotype"]


def feature_columns(df: DataFrame, mode: str = "all", include_morphology: bool = True, include_centroids: bool = True) -> list[str]:
    """Numeric columns to work on, by one of three rules.

    ``all``: all but ids and labels, to cluster on; ``suffix``: intensity
    statistics and shapes, by name; ``numeric``: all but labels, ids and
    centroids among them, to plot.
    """
    found = numeric(df)
    if mode == "suffix":
        found = sorted(c for c in found if statistic(c) or c in MORPHOLOGY)
    elif mode in ("all", "numeric"):
        found = [c for c in found if c not in (NOT_CLUSTERED if mode == "all" else NOT_PLOTTED)]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return [c for c in found if (include_morphology or c not in MORPHOLOGY) and (include_centroids or c not in CENTROIDS)]


def statistic(name: str) -> str | None:
    """The statistic that a column ``{channel}_{statistic}`` holds."""
    return next((s for s in STATISTICS if name.endswith("_" + s)), None)


def classify_columns(df: DataFrame) -> dict[str, list[str]]:
    """Columns by role: ``mean, median, other_intensity, morphology, ids, other``."""
    roles: dict[str, list[str]] = {k: [] for k in ("mean", "median", "other_intensity", "morphology", "ids", "other")}
    for c in df.columns:
        s = statistic(c)
        role = "ids" if c in IDS or c in CENTROIDS else "morphology" if c in MORPHOLOGY else s if s in ("mean", "median") else "other_intensity" if s else "other"
        roles[role].append(c)
    return roles


def first_of(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that is a column."""
    for c in names:
        if c in df.columns:
            return c
    raise ValueError(f"none of {names} is a column")
