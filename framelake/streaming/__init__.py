"""Streams of frames: slices of a rate, and sessions that open at a key frame."""
