"""Parsers of landed payloads, and writers. Fetching is left to whatever lands the files; parsers take DataFrames."""
