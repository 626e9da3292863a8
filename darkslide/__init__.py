"""darkslide: a Spark-native catalogue, search and data-preparation engine for picture collections."""

__version__ = "0.1.0"
