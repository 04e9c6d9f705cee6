"""Column expressions: paths, categories, formats, hashes."""

from stowage.functions.categories import (
    CATEGORIES,
    EXTENSIONS,
    category_dim,
    extension_dim,
    extensions_for_category,
    with_category,
)
from stowage.functions.formats import as_json, default_count, format_bytes, label_extension, percent, round_half_up
from stowage.functions.hashing import action_id, full_hash, partial_hash
from stowage.functions.paths import (
    basename,
    dirname,
    extension,
    from_order_key,
    join_path,
    listed,
    normalize_path,
    order_key,
    parent_name,
    stem,
    suffix,
)

__all__ = [
    "CATEGORIES", "EXTENSIONS", "category_dim", "extension_dim", "extensions_for_category", "with_category",
    "as_json", "default_count", "format_bytes", "label_extension", "percent", "round_half_up",
    "action_id", "full_hash", "partial_hash",
    "basename", "dirname", "extension", "from_order_key", "join_path", "listed", "normalize_path",
    "order_key", "parent_name", "stem", "suffix",
]
