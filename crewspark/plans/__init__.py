"""Queries over the driver's tables, each with the SQL that it is checked against."""
