"""Reports over scored catalogues, built on Spark DataFrames."""
