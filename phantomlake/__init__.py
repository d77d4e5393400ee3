"""Spark-native quality control of CT water phantoms, over whole fleets at once."""
