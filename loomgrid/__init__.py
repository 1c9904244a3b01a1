"""loomgrid: a PySpark-native engine for detection, grounding and conversation data."""

__version__ = "0.1.0"
