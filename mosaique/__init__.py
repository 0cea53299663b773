"""Media-library, raster and timeline analytics as Spark DataFrame jobs."""
