"""Composed jobs: feature extraction, nested evaluation, reduction, explanation, whole runs."""
