"""gridspark: dense arrays of rank one to three as Spark DataFrames."""
