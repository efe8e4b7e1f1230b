"""Operators over token streams, images and n-gram indexes."""
