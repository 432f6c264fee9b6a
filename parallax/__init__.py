"""Frame, depth and stereo dataflow on Spark DataFrames."""
