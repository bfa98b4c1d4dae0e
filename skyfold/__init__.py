"""Light-curve catalogue preparation as Spark DataFrame jobs."""
