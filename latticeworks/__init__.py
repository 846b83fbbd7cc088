"""A PySpark-native engine for sampled landscapes and other lattice data."""
