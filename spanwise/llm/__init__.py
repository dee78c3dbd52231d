"""Operators for preparing training text at scale: cleaning, scoring, deduplicating, mixing."""
