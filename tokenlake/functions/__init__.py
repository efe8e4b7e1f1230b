"""Kernels and column expressions."""
