"""Whole plans: the response to an evaluation, and the registered queries with their oracle."""
