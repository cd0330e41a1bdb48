"""corpusloom: document-corpus preparation and vector retrieval on PySpark."""
