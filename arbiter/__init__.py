"""Spark-native document-to-expert matching: scoring, assignment, audit and evaluation."""
