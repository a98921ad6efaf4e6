"""ledgerline: batch sales analytics as lazy Spark DataFrames."""
