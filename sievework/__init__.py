"""sievework: preparing, checking and comparing tabular data as Spark DataFrames."""
