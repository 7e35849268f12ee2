"""lexspark: a PySpark-native batch engine for retrieval and evaluation over structured legal text."""

__version__ = "0.1.0"
