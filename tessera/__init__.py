"""tessera: spatial tissue analytics and record-scale data preparation on Spark DataFrames."""
