"""Integrity rules, one function a rule: relations in, diagnostics out.

Every function takes DataFrames with the columns that it names and returns rows of
(ak, rule_id, category, severity, target, message), not yet distinct.
"""
