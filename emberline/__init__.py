"""A PySpark-native analytics engine for satellite thermal hot-spot data."""
