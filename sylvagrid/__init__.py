"""Spark-first analytics for gridded forest biomass, carbon and climate data."""
