"""Text analytics, retrieval and citation-graph operators over Spark DataFrames."""
