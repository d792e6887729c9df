"""tagtrail: visitor-journey analytics on Spark DataFrames."""
