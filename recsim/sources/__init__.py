"""Scans and sinks: rating/item readers, fold files, caches, metrics."""
