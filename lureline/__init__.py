"""Scam triage and corpus quality as PySpark DataFrame jobs."""
