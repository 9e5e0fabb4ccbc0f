"""lumenfold: analytics and training-data operators written for PySpark DataFrames."""
