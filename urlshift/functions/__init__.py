"""Column functions: every one is an expression over Spark built-ins."""

from urlshift.functions.domains import (
    clean_new_domain,
    display_from,
    first_label,
    force_https,
    host_of,
    is_local_host,
    path_of,
    protocol_of,
    sanitize_domain,
    sanitize_domain_strict,
    second_path_field,
    strip_scheme,
    strip_scheme_and_slash,
    trim_slashes,
    url_host,
    www_variants,
)
from urlshift.functions.text import (
    clean_string,
    count_occurrences,
    human_size,
    is_empty,
    is_true,
    lines_to_array,
    lower,
    map_get,
    map_keys,
    mapping_status,
    mmss,
    normalize_entry,
    site_table,
    title,
    upper,
)

__all__ = [
    "clean_new_domain", "clean_string", "count_occurrences", "display_from", "first_label", "force_https",
    "host_of", "human_size", "is_empty", "is_local_host", "is_true", "lines_to_array", "lower", "map_get",
    "map_keys", "mapping_status", "mmss", "normalize_entry", "path_of", "protocol_of", "sanitize_domain",
    "sanitize_domain_strict", "second_path_field", "site_table", "strip_scheme", "strip_scheme_and_slash",
    "title", "trim_slashes", "upper", "url_host", "www_variants",
]
