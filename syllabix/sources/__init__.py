"""Readers, writers and the course-data views of the test tables."""
