"""Queries over the driver's tables together with the SQL each one must agree with."""
