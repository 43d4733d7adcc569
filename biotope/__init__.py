"""PySpark-native site x period analytics for environmental epidemiology."""
