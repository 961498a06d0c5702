"""Relational, window and model operators over hourly multi-zone series."""
