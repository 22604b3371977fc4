"""Inputs and registered queries over the driver's tables."""
