"""Analytics over versioned work artifacts, on Spark DataFrames."""
