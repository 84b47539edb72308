"""The five criteria, and the registry by which more can be added.

A scorer takes (cells, context) and returns cell_id and score, 0 to 100, for the cells that have one.  ``Context`` holds
the layers as lazy tables; a layer that is not there is None.  Cells without a row get 0.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import styles
from ..functions import thresholds as t
from ..functions.storage import stored
from . import hydro, spatial, zonal

log = logging.getLogger("landrank")


@dataclass
class Context:
    """Layers and grid of a run. ``pixels``: row, col, x, y, z; ``terrain``: the same with slope and aspect."""

    bbox: tuple
    size: float = t.CELL_SIZE
    pixels: DataFrame | None = None
    terrain: DataFrame | None = None
    buildable_mask: bool = True
    origin: tuple[float, float] = (0.0, 0.0)
    resolution: float = 20.0
    nodata: float | None = -9999.0
    streams: DataFrame | None = None
    roads: DataFrame | None = None
    civic: DataFrame | None = None
    shared: dict = field(default_factory=dict)

    def measures(self) -> DataFrame:
        """Zonal sums, a row a cell, stored once: all scorers share one scan of the raster, which is by far the largest layer."""
        if "measures" not in self.shared:
            self.shared["measures"] = stored(zonal.all_measures(self.terrain, self.bbox, self.size, self.nodata), "measures")
        return self.shared["measures"]

    def ranges(self) -> DataFrame:
        """cell_id, range: height difference within each cell."""
        if self.terrain is None:
            found = zonal.heights(self.pixels, self.bbox, self.size, self.nodata)
        else:
            found = self.measures().where("n > 0")
        return found.select("cell_id", (F.col("most") - F.col("least")).alias("range"))


Scorer = Callable[[DataFrame, Context], DataFrame]
_known: dict[str, Scorer] = {}


def register(name: str) -> Callable[[Scorer], Scorer]:
    def keep(scorer: Scorer) -> Scorer:
        _known[name] = scorer
        return scorer

    return keep


def scorer(name: str) -> Scorer:
    if name not in _known:
        raise KeyError(f"Unknown scoring metric: {name}")
    return _known[name]


def names() -> list[str]:
    return list(_known)


def _none(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.lit(0.0).alias("score"))


@register("elevation")
def elevation(cells: DataFrame, context: Context) -> DataFrame:
    """By mean height; 50 where the raster does not reach, 0 without a raster."""
    if context.pixels is None and context.terrain is None:
        return _none(cells)
    means = context.measures() if context.terrain is not None else zonal.heights(context.pixels, context.bbox, context.size, context.nodata)
    joined = cells.select("cell_id").join(means.select("cell_id", "mean"), "cell_id", "left")
    return joined.select("cell_id", F.when(F.col("mean").isNull(), 50.0).otherwise(t.lookup(F.col("mean"), t.ELEVATION)).alias("score"))


@register("solar")
def solar(cells: DataFrame, context: Context) -> DataFrame:
    """By the share of pixels of an acceptable slope and aspect; 0 without any."""
    if context.terrain is None:
        return _none(cells)
    share = F.col("sunny") * 100.0 / F.when(F.col("classed") > 0, F.col("classed"))
    joined = cells.select("cell_id").join(context.measures().select("cell_id", "sunny", "classed"), "cell_id", "left")
    return joined.select("cell_id", t.lookup(share, t.SOLAR_PERCENT).alias("score"))


@register("buildable")
def buildable(cells: DataFrame, context: Context) -> DataFrame:
    """By the share of pixels that are not too steep; 0 without a mask."""
    if context.terrain is None or not context.buildable_mask:
        return _none(cells)
    share = F.col("buildable") * 100.0 / F.when(F.col("sloped") > 0, F.col("sloped"))
    joined = cells.select("cell_id").join(context.measures().select("cell_id", "buildable", "sloped"), "cell_id", "left")
    return joined.select("cell_id", t.lookup(share, t.BUILDABLE_PERCENT).alias("score"))


def access_features(roads: DataFrame | None, civic: DataFrame | None) -> DataFrame | None:
    """Roads that can be driven and addresses, all as segments."""
    layers = []
    if roads is not None:
        kept = roads.where(styles.driven(F.col("highway"))) if "highway" in roads.columns else roads
        layers.append(kept.select("x1", "y1", "x2", "y2"))
    if civic is not None:
        layers.append(civic.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    return reduce(DataFrame.unionByName, layers) if layers else None


@register("access")
def access(cells: DataFrame, context: Context) -> DataFrame:
    """By the distance of the nearest road or address; one join over both."""
    features = access_features(context.roads, context.civic)
    if features is None:
        return _none(cells)
    near = spatial.nearest_within(cells, features, t.ACCESS_REACH)
    joined = cells.select("cell_id").join(near, "cell_id", "left")
    return joined.select("cell_id", t.lookup(F.col("distance"), t.ACCESS_DISTANCE).alias("score"))


@register("hydro")
def hydro_power(cells: DataFrame, context: Context) -> DataFrame:
    """By the greatest power of the streams in reach; 0 without streams."""
    if context.streams is None:
        return _none(cells)
    best = hydro.best_power(cells, context)
    joined = cells.select("cell_id").join(best, "cell_id", "left")
    return joined.select("cell_id", t.lookup(F.coalesce("power", F.lit(0.0)), t.HYDRO_POWER).alias("score"))


def composite(cells: DataFrame, context: Context, weights: dict[str, float], enabled: list[str], grid: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Adds score_<name> for each enabled criterion and their weighted sum ``score``; all null for excluded cells.

    Terms are added in the order of the weights.  A criterion whose plan does not resolve against the layers, or whose stored
    sums are not to be found, scores 0, does not stop the others, and is logged; with ``strict`` it is an error, as an
    unknown name always is, so that such zeros do not pass for scores.  Criteria work on ``grid``, the same cells without
    what was joined to them, where it is given: reading those anew costs nothing, while the exclusions would be worked out
    once for each criterion.  Without it they work on the cells that are not excluded.
    """
    eligible = grid if grid is not None else cells.where("status <> 'excluded'") if "status" in cells.columns else cells
    scaled = t.scaled_weights(weights, enabled)
    found, out = {}, cells
    for name in enabled:
        run = scorer(name)
        try:
            found[name] = run(eligible, context).select("cell_id", F.col("score").alias(f"score_{name}"))
            found[name].schema  # noqa: B018  resolves the plan
        except AnalysisException:
            if strict:
                raise
            log.exception("Criterion %s failed; it scores 0", name)
            found[name] = eligible.select("cell_id", F.lit(0.0).alias(f"score_{name}"))
    for name in enabled:
        out = out.join(found[name], "cell_id", "left")
    open_ = F.col("status") != "excluded" if "status" in cells.columns else F.lit(True)
    out = out.withColumns({f"score_{n}": F.when(open_, F.coalesce(f"score_{n}", F.lit(0.0))) for n in enabled})
    total = reduce(lambda a, b: a + b, (F.col(f"score_{n}") * (w / 100) for n, w in scaled.items()), F.lit(0.0))
    return out.withColumn("score", F.when(open_, total))


def observed(cells: DataFrame, enabled: list[str]) -> tuple[DataFrame, Observation]:
    """The same cells, and what is counted as they first pass, at no cost of a scan: see ``told``."""
    seen = Observation()
    columns = [n for n in (*(f"score_{n}" for n in enabled), "score") if n in cells.columns]
    sums = [F.count("*").alias("cells"), F.count_if(F.col("status") == "excluded").alias("excluded")]
    sums += [f(c).alias(f"{name} {c}") for c in columns for name, f in (("mean", F.avg), ("median", lambda c: F.percentile_approx(c, 0.5)))]
    sums += [F.count_if(F.col("confidence_band") == b).alias(b) for b in ("high", "medium", "low") if "confidence_band" in cells.columns]
    return cells.observe(seen, *sums), seen


def told(seen: dict) -> list[str]:
    """Lines for the log: excluded cells, mean and median of each score, cells by confidence."""
    number = lambda x: "none" if x is None else f"{x:.1f}"
    out = [f"{seen['excluded']} of {seen['cells']} cells excluded"]
    out += [f"{n.removeprefix('mean ')}: mean {number(v)}, median {number(seen['median ' + n.removeprefix('mean ')])}" for n, v in seen.items() if n.startswith("mean ")]
    if "high" in seen:
        out.append(f"confidence: {seen['high']} high, {seen['medium']} medium, {seen['low']} low")
    return out
