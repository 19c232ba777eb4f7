"""Sanmaru: analysis of small-area regional data as Spark jobs."""
