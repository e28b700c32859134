"""SQL of the image filters on the 8 x 8 grids, built from one neighbourhood join."""

from __future__ import annotations

import math
from collections.abc import Iterable

from ..operators.stencils import CROSS, SQUARE, disk
from .pixel_queries import OTSU
from .views import GRID

PLACE = "acq_id, channel, y::BIGINT AS y, x::BIGINT AS x"


def near(name: str, source: str, offsets: Iterable[tuple], how: str, border: str = "nearest") -> str:
    """A table of ``how`` over the values ``s.value`` with weights ``w`` at (dy, dx, w) of each place."""

    def at(c: str) -> str:
        raw = f"g.{c} + d{c}"
        return f"greatest(least({raw}, 7), 0)" if border == "nearest" else f"CASE WHEN {raw} < 0 THEN -1 - ({raw}) WHEN {raw} > 7 THEN 15 - ({raw}) ELSE {raw} END"

    rows = ", ".join(f"({o[0]}, {o[1]}, {o[2] if len(o) > 2 else 1}::DOUBLE)" for o in offsets)
    join = f"s.acq_id = g.acq_id AND s.channel = g.channel AND s.y = {at('y')} AND s.x = {at('x')}"
    return f"{name} AS (SELECT g.acq_id, g.channel, g.y, g.x, {how} AS value FROM {source} g CROSS JOIN (VALUES {rows}) o(dy, dx, w) JOIN {source} s ON {join} GROUP BY ALL)"


def gaussian(name: str, source: str, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    steps = [(i, x / sum(w)) for i, x in zip(range(-r, r + 1), w, strict=True)]
    down, along = [(i, 0, x) for i, x in steps], [(0, i, x) for i, x in steps]
    return f"{near(name + '_y', source, down, 'sum(w * s.value)')}, {near(name, name + '_y', along, 'sum(w * s.value)')}"


def opened(name: str, source: str, radius: int, first: str = "min", then: str = "max") -> str:
    foot = disk(radius)
    return f"{near(name + '_e', source, foot, f'{first}(s.value)', 'reflect')}, {near(name, name + '_e', foot, f'{then}(s.value)', 'reflect')}"


def gradient(side: tuple[int, int, int]) -> str:
    scale = 2 * sum(side)
    y = near("gy", "grid", [(i, j, i * side[j + 1] / scale) for i, j in SQUARE], "sum(w * s.value)", "reflect")
    x = near("gx", "grid", [(i, j, j * side[i + 1] / scale) for i, j in SQUARE], "sum(w * s.value)", "reflect")
    size = "g AS (SELECT acq_id, channel, y, x, sqrt((gy.value ** 2 + gx.value ** 2) / 2) AS g FROM gy JOIN gx USING (acq_id, channel, y, x))"
    scaled = "round((g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w), 6)"
    return f"WITH {GRID}, {y}, {x}, {size} SELECT {PLACE}, {scaled} AS value FROM g WINDOW w AS (PARTITION BY acq_id, channel)"


BLUR = f"WITH {GRID}, {gaussian('b', 'grid', 0.8)} SELECT {PLACE}, round(value, 6) AS value FROM b"

BLACK = f"""WITH {GRID}, {opened("c", "grid", 2, "max", "min")}
SELECT {PLACE}, round(c.value - grid.value, 6) AS value FROM c JOIN grid USING (acq_id, channel, y, x)"""

DENOISE = f"""WITH {GRID}, a0 AS (SELECT * FROM grid WHERE channel = 'ch0'), a1 AS (SELECT * FROM grid WHERE channel = 'ch1'),
 {near("m", "a0", SQUARE, "median(s.value)")}, d AS (SELECT acq_id, channel, y, x, (a0.value - m.value) ** 2 AS value FROM a0 JOIN m USING (acq_id,
  channel, y, x)),
 {near("q", "d", SQUARE, "avg(s.value)", "reflect")},
 hot AS (SELECT acq_id, channel, y, x, CASE WHEN a0.value - m.value > 3 * sqrt(greatest(q.value, 1e-8)) THEN m.value ELSE a0.value END AS value FROM
  a0 JOIN m USING (acq_id, channel, y, x) JOIN q USING (acq_id, channel, y, x)),
 {gaussian("b", "hot", 0.8)},
 {near("h", "a1", CROSS, "median(s.value)")}, {opened("o", "h", 3)},
 n AS (SELECT acq_id, channel, y, x, greatest(h.value - o.value, 0) AS value FROM h JOIN o USING (acq_id, channel, y, x)),
 k AS (SELECT acq_id, min(value) AS a, max(value) AS b FROM a1 GROUP BY ALL), t AS (SELECT acq_id, max(value) AS m FROM n GROUP BY ALL),
 r AS (SELECT acq_id, channel, y, x, least(greatest(CASE WHEN m > 0 THEN value * b / m ELSE value END, least(a, 0)), b) AS value FROM n JOIN k USING
  (acq_id) JOIN t USING (acq_id)),
 whole AS (SELECT * FROM b UNION ALL SELECT * FROM r UNION ALL SELECT acq_id, channel, y, x, value FROM grid WHERE channel NOT IN ('ch0', 'ch1'))
SELECT {PLACE}, round(value, 6) AS value FROM whole"""

SEGMENT = f"""WITH RECURSIVE {GRID.replace("grid AS", "raw AS", 1)}, k AS (SELECT acq_id, channel, min(value) AS a, max(value) AS b FROM raw WHERE channel IN
  ('ch0', 'ch1') GROUP BY ALL),
 f AS (SELECT acq_id, y, x, avg((value - a) / (b - a)) AS v FROM raw JOIN k USING (acq_id, channel) GROUP BY ALL),
 grid AS (SELECT acq_id, 'fused' AS channel, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS value FROM f WINDOW w AS (PARTITION BY
  acq_id)), {OTSU},
 hit AS (SELECT acq_id, y, x, y * 8 + x AS p FROM grid JOIN otsu USING (acq_id, channel) WHERE value > threshold),
 r AS (SELECT acq_id, p AS root, p, y, x FROM hit UNION SELECT h.acq_id, r.root, h.p, h.y, h.x FROM r JOIN hit h ON h.acq_id = r.acq_id AND abs(h.y -
  r.y) + abs(h.x - r.x) = 1),
 g AS (SELECT acq_id, y, x, p, min(root) AS region FROM r GROUP BY ALL), s AS (SELECT acq_id, region, row_number() OVER (PARTITION BY acq_id ORDER BY
  region) AS cell_id FROM g GROUP BY acq_id, region HAVING count(*) BETWEEN 3 AND 10000)
SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, cell_id FROM g JOIN s USING (acq_id, region)"""
