"""loam: document preparation and retrieval on PySpark DataFrames."""
