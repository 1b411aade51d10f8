"""corvane: a PySpark-native analytics engine for molecular-ensemble data."""
