"""tidelog: LSN-versioned tables and corpus operators on Spark DataFrames."""
