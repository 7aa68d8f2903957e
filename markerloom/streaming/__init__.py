"""Marker tables that grow as reads arrive."""
