"""Vellumgrid: Spark DataFrame operators for vectorised map sheets and the text read from them."""
