"""A multi-model (document, graph, full-text, vector) analytics engine on Spark DataFrames."""
