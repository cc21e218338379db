"""erspark: DataFrame-native record linkage and data processing on PySpark."""
