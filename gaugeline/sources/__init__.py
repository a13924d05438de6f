"""Readers, writers and sheet harmonisation."""
