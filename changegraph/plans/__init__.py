"""Registered queries over the star-schema tables, with SQL for comparison."""
