"""News, text and market analytics as Spark queries."""
