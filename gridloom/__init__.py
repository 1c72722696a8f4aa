"""gridloom: grid analytics, feature engineering, evaluation and corpus operators on Spark DataFrames."""
