"""Code-fact analytics on Spark: definitions, references and files as DataFrames."""

__version__ = "0.1.0"
