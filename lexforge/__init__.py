"""lexforge: PySpark-native analytics for reasoning-puzzle corpora."""
