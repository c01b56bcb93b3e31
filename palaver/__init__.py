"""palaver: a PySpark-native analytics engine for conversational data."""
