"""Readers: SQL dumps, project files, site lists, options and the table catalogue."""
