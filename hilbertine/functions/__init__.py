"""Scalar functions: Hilbert keys, cube arithmetic, flags."""
