"""Mail-log reconstruction and search, and training-data operators, on Spark."""
