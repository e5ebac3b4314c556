"""The query catalogue with the SQL that each query is checked against."""
