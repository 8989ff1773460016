"""Data cleaning, profiling and preparation as plain PySpark DataFrame functions."""
