"""Spark-first comparison of genome assemblies: alignments, intervals, grids, rearrangement search."""

__version__ = "0.1.0"
