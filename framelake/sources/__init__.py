"""Readers of media files: listings, byte ranges, and one module by container, which give nodes, tracks and samples."""
