"""Operators over stage, graph and evidence tables."""
