"""Registered queries over the driver's tables, with equal SQL where SQL can say it."""
