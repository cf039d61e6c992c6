"""Readers and writers: logger files, weather and lab sheets, summary tables."""
