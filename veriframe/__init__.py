"""veriframe: evidence-backed entity profiles as PySpark DataFrame operators."""

__version__ = "0.1.0"
