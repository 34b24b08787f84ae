"""tessella: generation, encoding, analysis and checking of scene datasets with Spark DataFrames."""

__version__ = "0.1.0"
