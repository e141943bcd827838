"""boxwright: Spark-native analytics over object-detection datasets."""
