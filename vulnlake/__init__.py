"""Vulnerability-intelligence analytics on Spark."""
