"""DataFrame operators: matching, grid joins, grouping, scoring, sequence folds and raster steps."""
