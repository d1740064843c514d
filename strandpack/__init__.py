"""strandpack: multi-channel telemetry compression analytics on PySpark."""

__version__ = "0.1.0"
