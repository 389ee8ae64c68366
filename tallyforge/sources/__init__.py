"""Readers of tables, carriers and archives."""
