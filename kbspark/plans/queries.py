"""All checked queries; importing the area modules fills the registry."""

from kbspark.plans import (  # noqa: F401
    catalog_checks, ingest_checks, matching, rewrite_checks, stream_checks, text_functions, thread_checks)
from kbspark.plans.registry import ORACLE, QUERIES  # noqa: F401
