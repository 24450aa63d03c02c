"""epilimnia: environmental time-series analytics as Spark DataFrame operators."""
