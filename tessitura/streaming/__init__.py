"""Stateful operators over event streams, and their batch twins."""
