"""Readers and writers for listings, skills, titles, pages and result tables."""
