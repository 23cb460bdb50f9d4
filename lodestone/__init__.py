"""Text-corpus analytics as PySpark DataFrame operators."""
