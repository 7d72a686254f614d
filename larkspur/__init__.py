"""A knowledge-retrieval and corpus engine written with the DataFrame, SQL and Structured Streaming APIs."""

__version__ = "0.1.0"
