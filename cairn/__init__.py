"""Cairn: ranking and classification of program statements from dependence graphs, on Spark."""
