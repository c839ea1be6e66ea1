"""Readers, parsers and writers of traces and telemetry."""
