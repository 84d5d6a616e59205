"""Parsing of source text: what regular expressions over columns cannot say.

Each parser is a plain function of one file's text; :func:`routeloom.extract.tables.per_file` runs it over a relation of files in
Arrow batches, so a file is read once and rows never cross files.
"""
