"""Sensor-fusion and signal-quality analytics as Spark DataFrame operators."""
