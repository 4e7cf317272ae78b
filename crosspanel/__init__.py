"""Cross-sectional panel analytics expressed as Spark DataFrame jobs."""
