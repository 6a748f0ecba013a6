"""Plane geometry: areas and lines on the driver, Column expressions, batch kernels."""
