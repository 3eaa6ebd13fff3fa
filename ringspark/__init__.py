"""Learning and imputation from sufficient statistics, on Spark DataFrames."""
