"""Trial-response analytics and training-data operators on Spark."""
