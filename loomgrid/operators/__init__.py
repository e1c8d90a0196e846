"""Operators over elements, contacts, intervals and matrices, as functions of DataFrames."""
