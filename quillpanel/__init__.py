"""A PySpark-native engine for panels of bars: quality, cleaning, indicators, signals, reduction."""
