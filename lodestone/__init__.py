"""Defect analytics, retrieval and trace analytics over messy tables, as DataFrame operators."""
