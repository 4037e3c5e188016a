"""Analytics over corpora of annotated documents, on Spark."""
