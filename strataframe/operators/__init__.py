"""Relational, array, metric, box, segment and graph operators."""
