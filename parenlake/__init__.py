"""Structural source analytics on Spark: syntax trees as relations."""
