"""Declared tables, typed predicates and checked reports, run as ordinary Spark DataFrame plans."""

from .errors import DeclarationError, QueryError, Refused
from .model import Catalog, Column, ForeignKey, Relation, Table

__all__ = ["Catalog", "Column", "DeclarationError", "ForeignKey", "QueryError", "Refused", "Relation", "Table"]
