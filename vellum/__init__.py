"""vellum: a PySpark-native library for collections of web documents."""

__version__ = "0.1.0"
