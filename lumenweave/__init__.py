"""lumenweave: timeline, document, graph and training-corpus analytics as Spark DataFrame plans."""
