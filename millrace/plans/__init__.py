"""Recipes, lineage and builds over catalog tables."""
