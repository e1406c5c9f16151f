"""quern: corpus preparation, hybrid retrieval and evaluation as Spark plans."""

__version__ = "0.1.0"
