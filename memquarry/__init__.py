"""A PySpark-native analytics engine for multi-tenant memory data: typed keyspaces,
change logs, vector collections and text pipelines, as DataFrame operators."""

from __future__ import annotations
