"""Media-timeline analytics as DataFrame-in / DataFrame-out PySpark functions."""
