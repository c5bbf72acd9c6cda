"""Measurement analytics on Spark: sweeps, event intervals, shapes, catalogues and decision rules as DataFrame operators."""
