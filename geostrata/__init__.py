"""geostrata: PySpark-native spatial SQL analytics."""

__version__ = "0.1.0"
