"""Operators on the whole texts of landed files, for building a training corpus.

A file of the registry's world (an order of norms, an extract, a form) is landed
as grids or fragments; ``records.file_texts`` makes one text of each.  Every
operator here takes such records, ``(file, text)``, or registry rows with their
municipality and units.  ``queries`` maps the given tables to these records and
the results back; nothing outside this folder imports it.
"""
