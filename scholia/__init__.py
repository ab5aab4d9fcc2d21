"""Scholia: Spark jobs that build, align, query and audit a corpus of teaching content."""
