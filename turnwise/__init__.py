"""Turnwise: conversational-turn analysis and corpus processing as PySpark DataFrame plans."""
