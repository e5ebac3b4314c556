"""Column builders used by the operators."""
