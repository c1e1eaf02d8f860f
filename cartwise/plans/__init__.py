"""Composed pipelines: invoice build, ratings, bundles, models."""
