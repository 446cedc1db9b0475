"""A PySpark engine for estates of office-style documents, events and training corpora."""
