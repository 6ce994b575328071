"""Registered queries: each operator on the driver's tables, beside the SQL it must agree with."""

from . import basics, blocks, evaluation, features, recommend, relational, versions, windows
from .base import register

QUERIES, ORACLE = register.queries, register.sql
