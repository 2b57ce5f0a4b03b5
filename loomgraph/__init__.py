"""loomgraph: lineage and dependency analytics expressed as Spark DataFrames."""
