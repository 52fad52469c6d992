"""Where nodes and edges come from: DataFrames registered in a catalog, and stored snapshots."""
