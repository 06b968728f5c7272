"""wayfold: Spark-native analytics for irregular time series, motion trajectories and activity telemetry."""

__version__ = "0.1.0"
