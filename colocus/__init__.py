"""Spatial co-location, class assignment and time-to-event analysis as Spark plans."""
