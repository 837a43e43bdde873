"""cellweave: Spark-first analytics for cell-by-gene matrices and the tables around them."""

__version__ = "0.1.0"
