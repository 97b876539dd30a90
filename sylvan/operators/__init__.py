"""Axis joins, node-set operators, and the per-document interpreter."""
