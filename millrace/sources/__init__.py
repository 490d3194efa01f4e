"""Event generators, and decoders of files and stream envelopes."""
