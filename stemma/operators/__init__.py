"""Operators over DataFrames: units and sections, alignment, classification, facts, audits, metrics."""
