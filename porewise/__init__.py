"""Error patterns of nanopore reads as Spark DataFrames."""
