"""Operators of a training-data pipeline: cleaning, scoring, duplicates, decontamination and mixing."""
