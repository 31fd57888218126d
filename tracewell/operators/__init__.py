"""Framing, parsing, inference, mapping, integrity, entities, drift and onboarding as DataFrame operators."""
