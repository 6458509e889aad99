"""Operators of a training-data pipeline: de-duplication, extraction, archives, decontamination, filters.

Nothing outside this folder imports it. Every operator takes the names of its id and text columns, reads
only these, and gives results keyed by the id, so further columns and their names do not matter.
"""
