"""Keyword-table detection and page-text analytics on Spark DataFrames."""

from pagesieve.definitions import Phrase, TableRule

__all__ = ["Phrase", "TableRule"]
