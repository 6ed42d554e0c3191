"""Readers of record sources; importing the package registers them."""

from . import csv, json_profiles, notes, resume
from .registry import Source, known_sources, read_sources, reader, register

__all__ = ["Source", "csv", "json_profiles", "known_sources", "notes", "read_sources", "reader", "register", "resume"]
