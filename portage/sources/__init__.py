"""Scans of files, directories, tables and queries, and listings of files."""
