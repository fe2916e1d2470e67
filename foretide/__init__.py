"""foretide: a Spark-native engine that turns loosely structured public records into linked, scored, evaluated forecasts."""

__version__ = "0.1.0"
