"""sparkfeat: feature engineering, validation, feature store, model scoring, drift,
experiments and operational metrics as Spark DataFrame jobs."""

__version__ = "0.1.0"
