"""Readers and writers: tables, split documents, volumes, detection bags, models and reports."""
