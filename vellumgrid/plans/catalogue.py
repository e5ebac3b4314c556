"""All queries of the library: name to function of (spark, folder of tables), and name to the equal SQL."""

from __future__ import annotations

from vellumgrid.plans import character_queries, detail_queries, fold_queries, form_queries, more_queries, raster_queries, score_queries, street_queries, text_queries

_PARTS = (street_queries, character_queries, score_queries, text_queries, raster_queries, fold_queries, more_queries, detail_queries, form_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
