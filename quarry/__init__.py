"""quarry: document retrieval and grounded analytics on Spark DataFrames."""
