"""Registered queries: what they read, and the same in SQL."""
