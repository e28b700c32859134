"""The whole feature extraction: pixels and masks of all acquisitions to one table of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import arcsinh, source_well
from .features import CELL, in_cells, intensity_long, intensity_wide, morphology, perimeter, solidity, touches_border
from .spillover import compensate_sets
from .stencils import STEPS, denoise

STATISTICS = ["mean", "median", "std", "mad", "p10", "p90", "integrated", "frac_pos"]


def extract_features(
    pixels: DataFrame, mask: DataFrame, channels: Sequence[str], cofactor: float | None = 10.0, pixel_size_um: float = 1.0, shapes: bool = True,
    denoising: dict[str, dict] | None = None, order: Sequence[str] = STEPS, spill: DataFrame | None = None, mapping: dict[str, str] | None = None, method: str = "pgd",
    acquisitions: DataFrame | None = None,
) -> DataFrame:
    """Shapes and intensities of all cells of all acquisitions, a row for each ``acq_id, cell_id``.

    In this order: ``denoising`` (settings of ``denoise``, by channel, with its
    ``order``); statistics of each cell and channel; unmixing of all of them but
    ``frac_pos`` with the matrix ``spill`` (``mapping``: channel -> channel of the
    matrix); arcsinh with ``cofactor``, again of all but ``frac_pos``; shapes; and,
    with ``acquisitions`` (``acq_id, name, well, source_file, height, width``, a
    row for each), names of file and well and whether a cell touches the border.
    """
    channels = list(channels)
    own = pixels.filter(F.col("channel").isin(channels))
    clean = denoise(own, denoising, order) if denoising else own
    cells = intensity_wide(intensity_long(in_cells(clean, mask)), channels)
    measured = [s for s in STATISTICS if s != "frac_pos"]
    if spill is not None:
        cells = compensate_sets(cells, spill, [{f"{c}_{s}": (mapping or {}).get(c, c) for c in channels} for s in measured], method)
    if cofactor is not None:
        cells = cells.withColumns({f"{c}_{s}": arcsinh(F.col(f"`{c}_{s}`"), cofactor) for c in channels for s in measured})
    if shapes:
        cells = morphology(mask, pixel_size_um).join(perimeter(mask), CELL).join(solidity(mask), CELL).join(cells, CELL)
    if acquisitions is None:
        return cells
    border = touches_border(mask, acquisitions.select("acq_id", "height", "width"))
    ids = acquisitions.select("acq_id", F.col("name").alias("acquisition_name"), "well", "source_file", source_well(F.col("source_file"), F.col("well")).alias("source_well"))
    return cells.join(border, CELL, "left").join(ids, "acq_id", "left")
