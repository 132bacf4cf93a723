"""Shortlisting and corpus operators for Spark."""
