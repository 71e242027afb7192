"""Listings, file contents and sinks; the only places that touch files by path."""
