"""Operators over points, edges and searches."""
