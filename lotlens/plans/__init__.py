"""All queries over the star-schema tables; importing the package registers them."""

from . import extras, firms, grading, language, lexicon, market, notices, profiles
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "extras", "firms", "grading", "language", "lexicon", "market", "notices", "profiles"]
