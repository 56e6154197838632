"""Spark-native bibliographic entity resolution and co-citation analytics."""
