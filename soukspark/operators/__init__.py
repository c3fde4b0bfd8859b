"""Operators on catalogues, queues and listings."""
