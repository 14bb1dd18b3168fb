"""A PySpark-native analytics engine for legislative and other relational event data."""
