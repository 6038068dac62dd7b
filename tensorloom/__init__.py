"""tensorloom: tensor analytics and compression on Spark DataFrames."""
