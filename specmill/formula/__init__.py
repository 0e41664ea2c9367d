"""Evaluation of spreadsheet formulas over cell tables."""
