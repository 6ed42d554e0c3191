"""tributary: record fusion and corpus analytics as Spark DataFrame programs."""
