"""Registered queries, their derived inputs and their oracle SQL."""
