"""Relational and statistical operators over sites, calls and samples."""
