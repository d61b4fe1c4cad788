"""Data-intelligence operators for PySpark: DataFrame in, DataFrame out."""
