"""Spark jobs for physiological waveform tables."""
