"""The text report of score distributions: aggregates on Spark, text on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import statistics
from ..sources.config import Config

COLUMNS = ["score_hydro", "score_solar", "score_elevation", "score_access", "score_buildable", "score"]
BAR = 40
NONE = "  No valid data\n"


def stats_text(row) -> str:
    if row is None or not row["n"]:
        return NONE
    ranks = " | ".join(f"P{p}: {row[f'p{p}']:.1f}" for p in statistics.PERCENTILES)
    return (
        f"  Count: {row['n']:,}  |  Min: {row['least']:.1f}  |  Max: {row['most']:.1f}  |  Mean: {row['mean']:.1f}  |  Median: {row['median']:.1f}\n"
        f"  Percentiles: {ranks}\n"
        f"  Cells at 100: {row['at_100']:,} ({row['at_100_percent']:.1f}%)  |  Cells at 0: {row['at_0']:,} ({row['at_0_percent']:.1f}%)\n"
    )


def histogram_text(rows: list) -> str:
    if not rows or not sum(r["n"] for r in rows):
        return NONE
    most = max(r["n"] for r in rows)
    return "".join(f"  {r['low']:5.0f}-{r['high']:5.0f} | {'#' * int(r['n'] / most * BAR):<{BAR}} {r['n']:,}\n" for r in sorted(rows, key=lambda r: r["bin"]))


def bands_text(cells: DataFrame) -> str:
    if "confidence_band" not in cells.columns:
        return "  No confidence_band column found\n"
    rows = statistics.band_counts(cells).collect()
    return "".join(f"  {r['band']}: {r['n']:,} ({r['percent']:.1f}%)\n" for r in rows) if sum(r["n"] for r in rows) else NONE


def text(cells: DataFrame) -> str:
    """Sections of all scores and the confidence; two aggregations over the cells for all of them."""
    present = [c for c in [*COLUMNS, "confidence"] if c in cells.columns]
    facts = {r["column"]: r for r in statistics.stats(cells, present).collect()} if present else {}
    bins: dict[str, list] = {}
    for r in statistics.histogram(cells, present).collect() if present else []:
        bins.setdefault(r["column"], []).append(r)
    out = []
    for c in [*COLUMNS, "confidence"]:
        if c not in cells.columns:
            out.append(f"--- {c} ---\n  Column not found in output\n")
            continue
        out += [f"--- {c} ---", stats_text(facts.get(c)), histogram_text(bins.get(c, [])) if c in facts else NONE]
        if c == "confidence":
            out += ["  Confidence bands:", bands_text(cells)]
    return "\n".join(out)


def scored_cells(spark: SparkSession, config: Config) -> DataFrame:
    path = config.output / "scored_cells.parquet"
    if not path.exists():
        raise FileNotFoundError(f"scored_cells not found at {path}. Run 'score' first.")
    return spark.read.parquet(str(path))


def run(spark: SparkSession, config: Config) -> str:
    found = text(scored_cells(spark, config))
    print(found)
    return found
