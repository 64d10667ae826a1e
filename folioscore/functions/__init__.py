"""Column functions: text, geometry, calibration, structured fields."""
