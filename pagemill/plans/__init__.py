"""Named queries: importing this package registers all of them."""

from pagemill.plans import (  # noqa: F401
    crawl_queries,
    extraction_queries,
    learning_queries,
    listing_queries,
    page_queries,
    quality_queries,
    sql_surface,
    text_queries,
    url_queries,
)
from pagemill.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
