"""Graph connectivity analytics and corpus preparation on PySpark DataFrames."""
