"""quire: corpus analytics for book-like text on PySpark DataFrames."""
