"""Catalogs of tables and readers and writers of sample files."""
