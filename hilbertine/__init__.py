"""Particle-table analytics on Spark: Hilbert keys, leaves, typed payloads, exchange."""
