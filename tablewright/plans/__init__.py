"""Queries registered for the driver, with the SQL that says the same."""
