"""Graph features, communities and node classification as Spark plans."""

__version__ = "0.1.0"
