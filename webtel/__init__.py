"""PySpark engine for privacy-preserving web telemetry."""

__version__ = "0.1.0"
