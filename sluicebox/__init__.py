"""Sluicebox: curation, verification and evaluation of code-instruction data on Spark."""
