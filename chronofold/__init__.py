"""A PySpark-native engine for noisy, time-ordered observations and for training-data tables."""
