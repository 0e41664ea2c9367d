"""specmill: comparison of technical specifications across product configurations, on PySpark."""

__version__ = "0.1.0"
