"""Operators of a training-data pipeline: filters, near-duplicate joins, audits, rollups and mixing."""
