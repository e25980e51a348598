"""Decoders of self-describing containers: bytes of one file in, event rows out."""
