"""PySpark-native analytics for property-catastrophe risk."""
