"""Addresses of the migrated sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlshift.functions import is_empty, protocol_of, strip_scheme_and_slash

NETWORK_ADMIN = "/wp-admin/network/"
SITE_ADMIN = "/wp-admin"


def site_links(sites: DataFrame, main_id: int, is_network: bool = True) -> DataFrame:
    """``(blog_id, role, url, admin_url)`` of every listed site ``(blog_id, url)``."""
    url = F.concat(protocol_of("url"), strip_scheme_and_slash("url"))
    role = F.when(F.col("blog_id") == main_id, F.lit("Main")).otherwise(F.lit("Subsite"))
    return sites.where(F.col("blog_id").isNotNull() & ~is_empty("url")).select(
        "blog_id",
        role.alias("role"),
        url.alias("url"),
        F.concat(url, F.lit(NETWORK_ADMIN if is_network else SITE_ADMIN)).alias("admin_url"),
    )
