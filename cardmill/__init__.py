"""cardmill: record linkage and curation of short text records on PySpark."""

__version__ = "0.1.0"
