"""Spark-native analytics over text and tabular records that are held at several sites."""
