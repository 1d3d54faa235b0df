"""Training-data operators; nothing else in the library imports this subpackage.

Every operator takes and returns DataFrames, reads only the columns it names
(so extra columns, whatever they are called, pass by untouched) and defines a
result for null, empty and very long texts, repeated rows and empty tables.
"""
