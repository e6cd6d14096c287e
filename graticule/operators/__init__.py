"""Operators over long-form grids, catalogs, lineage tables and job logs."""
