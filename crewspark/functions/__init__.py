"""Column functions: calendar, numbers, text, labour figures, geometry."""
