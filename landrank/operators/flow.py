"""Raster hydrology: depressions, flow direction, flow accumulation, over pixel tables of any size."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored

TILE = 256
# Pointer code of each direction as (row step, column step), clockwise from north-east.
POINTERS = {1: (-1, 1), 2: (0, 1), 4: (1, 1), 8: (1, 0), 16: (1, -1), 32: (0, -1), 64: (-1, -1), 128: (-1, 0)}


def flood(z: np.ndarray, level: np.ndarray, steps: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least levels to which water stands, and steps over ground of that level to where it falls, from the settled pixels, lowest first."""
    out, far = level.copy(), steps.copy()
    heap = [(level[r, c], steps[r, c], r, c) for r, c in zip(*np.nonzero(settled), strict=True)]
    heapq.heapify(heap)
    height, width = z.shape
    while heap:
        now, step, r, c = heapq.heappop(heap)
        if (now, step) > (out[r, c], far[r, c]):
            continue
        for dr, dc in POINTERS.values():
            i, j = r + dr, c + dc
            if 0 <= i < height and 0 <= j < width and not np.isnan(z[i, j]):
                rise = (z[i, j], 0) if z[i, j] > now else (now, step + 1)
                if rise < (out[i, j], far[i, j]):
                    out[i, j], far[i, j] = rise
                    heapq.heappush(heap, (*rise, i, j))
    return out, far


def fill_depressions(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, z raised to the lowest level at which water leaves the raster, and ``steps``; its rim, and pixels by missing ones, are outlets.

    ``steps``: over how many pixels of its own level the water of a pixel goes until it falls or leaves, 0 at once; by it
    flow finds its way over filled and flat ground.  Each round floods every tile from its own outlets and from the levels
    of the pixels around it, and rounds end when nothing falls.  A tile is the largest group; rounds are tables in the
    shared folder.
    """
    near = lambda k: F.array_distinct(F.array(*(F.expr(f"floor(({k} + {d}) / {tile})") for d in (-1, 0, 1))))
    pixels = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"))
    around = [F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in POINTERS.values()]
    beside = pixels.select(F.explode(F.array(*around)).alias("p")).groupBy("p.row", "p.col").agg(F.count("*").alias("n"))
    state = pixels.join(beside, ["row", "col"], "left")
    outlet = F.coalesce(F.col("n"), F.lit(0)) < 8
    level = F.when(outlet, F.col("z")).otherwise(F.lit(float("inf")))
    state = stored(state.select("row", "col", "z", outlet.alias("outlet"), level.alias("level"), F.lit(0).cast("long").alias("steps")), "flood")

    def one(key, part):
        import pandas as pd

        r0, c0 = int(part["row"].min()), int(part["col"].min())
        shape = (int(part["row"].max()) - r0 + 1, int(part["col"].max()) - c0 + 1)
        z, level, steps, start = np.full(shape, np.nan), np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
        at = (part["row"].to_numpy() - r0, part["col"].to_numpy() - c0)
        z[at], level[at], steps[at] = part["z"], part["level"], part["steps"]
        start[at] = np.isfinite(part["level"].to_numpy())
        found, far = (x[at] for x in flood(z, level, steps, start))
        own = ((part["row"] // tile == key[0]) & (part["col"] // tile == key[1])).to_numpy()
        out, found, far = part[own], found[own], far[own]
        fell = (found < out["level"].to_numpy()) | (far < out["steps"].to_numpy())
        return pd.DataFrame({"row": out["row"], "col": out["col"], "z": out["z"], "outlet": out["outlet"], "level": found, "steps": far, "fell": fell})

    while True:
        tiles = state.withColumn("__tr", F.explode(near("row"))).withColumn("__tc", F.explode(near("col")))
        kinds = "row long, col long, z double, outlet boolean, level double, steps long, fell boolean"
        after = stored(tiles.groupBy("__tr", "__tc").applyInPandas(one, kinds), "flood")
        state = after.drop("fell")
        if after.where("fell").isEmpty():
            return state.select("row", "col", F.col("level").alias("z"), "steps")


def pointers(pixels: DataFrame) -> DataFrame:
    """row, col, pointer: code of the steepest way down among eight neighbours, 0 where none is lower.

    Every pixel sends its height to its neighbours and one aggregation picks; of equally steep ways the smallest code.  Of
    a filled raster, with ``steps``, a pixel without a lower neighbour points to the neighbour of its level that is fewest
    steps from where the water falls, so flow passes flat ground; only outlets have no pointer.
    """
    level = "steps" in pixels.columns
    steps = F.col("steps") if level else F.lit(0)
    rows = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("z").cast("double"), steps.cast("long").alias("steps"))
    sent = [F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), F.lit(code).alias("code"), F.lit(float(np.hypot(r, c))).alias("far")) for code, (r, c) in POINTERS.items()]
    offers = rows.select(F.col("z").alias("there"), F.col("steps").alias("then"), F.explode(F.array(*sent)).alias("s")).select("s.*", "there", "then")
    drop = (F.col("z") - F.col("there")) / F.col("far")
    nearer = (F.col("there") == F.col("z")) & (F.col("then") < F.col("steps")) if level else F.lit(False)
    drops = offers.join(rows, ["row", "col"]).withColumn("drop", drop).where((F.col("drop") > 0) | nearer)
    best = drops.groupBy("row", "col").agg(F.max_by("code", F.struct("drop", -F.col("then") if level else F.lit(0), -F.col("code"))).alias("pointer"))
    return rows.select("row", "col").join(best, ["row", "col"], "left").select("row", "col", F.coalesce("pointer", F.lit(0)).alias("pointer"))


def accumulation(directions: DataFrame) -> DataFrame:
    """row, col, cells: how many pixels drain through each, itself included.

    By doubling: a pixel's count takes in the counts of those whose way of 2 ** k steps ends in it, so rounds are as many as
    the longest way has binary digits.
    """
    step = F.lit(None)
    for code, (r, c) in POINTERS.items():
        step = F.when(F.col("pointer") == code, F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c"))).otherwise(step)
    state = stored(directions.select("row", "col", F.lit(1).cast("long").alias("cells"), step.alias("to")), "flow")
    while True:
        moving = state.where("to is not null")
        if moving.isEmpty():
            return state.select("row", "col", "cells")
        gained = moving.groupBy(F.col("to.r").alias("row"), F.col("to.c").alias("col")).agg(F.sum("cells").alias("more"))
        ahead = state.select(F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("to"), F.col("to").alias("next"))
        state = stored(
            state.join(gained, ["row", "col"], "left").join(ahead, "to", "left")
            .select("row", "col", (F.col("cells") + F.coalesce("more", F.lit(0))).alias("cells"), F.col("next").alias("to")),
            "flow",
        )
