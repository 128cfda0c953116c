"""A PySpark-native engine that inspects, scores and disarms document files at corpus scale."""
