"""Operators on observations, masks and rasters."""
