"""Guarded, tenant-scoped SQL: which statements are let through, over which views, and how results come back."""
