"""millrace: lakehouse sync, SQL models and usage billing as Spark jobs.

Every operator is a function from DataFrames to a DataFrame.  Writers are thin
shells around them.  See the README for the module map.
"""
