"""Relational operators on snapshots, facts, edges and reports."""
