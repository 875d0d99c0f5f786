"""PySpark-native analytics over code graphs and findings."""
