"""Operators for preparing training corpora: de-duplication, scoring, decontamination, extraction, formatting and sharding."""
