"""Relational and ordered operators over transcripts."""
