"""Candidate / vacancy matching as Spark DataFrame jobs."""
