"""Relational, graph, scoring and extraction operators over relations of code."""
