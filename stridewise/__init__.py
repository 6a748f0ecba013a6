"""stridewise: pedestrian-trajectory analytics as lazy Spark DataFrame plans."""
