"""lodeworks: retrieval, full-text, key-value and corpus analytics as PySpark DataFrame plans."""
