"""weft: a PySpark-native analytics engine for time series on graphs."""
