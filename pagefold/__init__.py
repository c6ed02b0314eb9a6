"""Page-oriented document processing and corpus preparation as Spark queries."""
