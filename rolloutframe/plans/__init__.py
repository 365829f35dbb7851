"""Registered queries: operators applied to the test tables, with the SQL they are held against."""

from . import data, more, records, rollouts, storage, streams, tokens  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
