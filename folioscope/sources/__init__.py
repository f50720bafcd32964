"""Readers that produce normalised input tables and writers for result tables."""
