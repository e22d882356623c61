"""Entity resolution on Spark DataFrames: normalise, block, rank, score and decide."""
