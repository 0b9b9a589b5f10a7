"""Operators over op logs: each is a pure function of a log and an explicit time."""
