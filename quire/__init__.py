"""quire: document reconstruction over whole corpora, on Spark DataFrames."""

__version__ = "0.1.0"
