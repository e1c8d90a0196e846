"""loomgrid: positioned elements, sparse contacts between them, interval algebra - as Spark DataFrames."""
