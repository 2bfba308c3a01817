"""Streams of worker events."""
