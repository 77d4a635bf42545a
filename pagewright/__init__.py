"""Document outline analytics and corpus preparation on Spark DataFrames."""
