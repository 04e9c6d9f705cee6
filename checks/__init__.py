"""Fixture views, registered queries and their SQL for the correctness check."""
