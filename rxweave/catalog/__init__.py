"""All registered queries."""

from rxweave.catalog import core, feeds, history, longitudinal, quality, streams, texts  # noqa: F401
from rxweave.catalog.base import CHECKS, QUERIES  # noqa: F401
