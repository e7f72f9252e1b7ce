"""galleon: a PySpark-native analytics engine for large tagged media collections."""
