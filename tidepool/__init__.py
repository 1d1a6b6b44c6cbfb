"""Memory and event analytics on Spark: set-oriented operators over DataFrames."""
