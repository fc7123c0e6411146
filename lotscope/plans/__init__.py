"""Whole runs: refreshing the marts and producing all sections of all reports."""
