"""Adjudication of competing interval annotations on Spark."""
