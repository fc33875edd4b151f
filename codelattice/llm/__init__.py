"""Operators for preparing large text corpora: scans, sampling, dedup, tokenising.

Nothing outside this subpackage imports it.
"""
