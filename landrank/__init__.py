"""Land suitability on Spark: grids, spatial joins, zonal statistics, scores, ranks."""
