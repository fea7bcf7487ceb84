"""Batch jobs that turn fleets of rooftop-solar exports and weather into yield-loss tables."""
