"""Readers, writers and the adapters that shape raw tables into domain tables."""
