"""Adapter views and plan rewrites."""
