"""Operators over whole tables: joins by overlap, regions of interest."""
