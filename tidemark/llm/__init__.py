"""Training-data operators: text, page, vector and conversation jobs for Spark."""
