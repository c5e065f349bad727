"""Strata: a Spark-first analytics engine (relational, OLAP, time-series, graph, vector and streaming operators)."""

__version__ = "0.1.0"
