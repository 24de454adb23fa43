"""Graph layout by stress minimisation, and its analytics, on Spark DataFrames."""
