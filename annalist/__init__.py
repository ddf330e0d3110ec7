"""Annalist: archive organising, full-text search and proofreading on Spark."""
