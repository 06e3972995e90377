"""The operators of the mining engine, each from DataFrames to a DataFrame."""

from .condense import condense
from .dictionary import dictionary, frequent_items, item_counts, lookup, with_ids, word_count
from .encode import collect, decode, encode, names, pack_duplicates, positions, total_support
from .mine import frequent_single, max_support_by_left, mine, mine_levels, two_sequence_postings
from .pivot import by_partition, item_parts, mine_pivot, pack_items, part_items, pivot_intervals, pivot_offsets, rewrite, segments
from .sinks import as_text, each_pattern, save_encoded, write_dictionary, write_encoded_patterns, write_encoded_text, write_patterns
from .stats import distinct_items_histogram, length_histogram
from .tables import drop_tables, table

__all__ = [
    "as_text", "by_partition", "collect", "condense", "decode", "dictionary", "distinct_items_histogram", "drop_tables", "each_pattern", "encode", "frequent_items",
    "frequent_single", "item_counts", "item_parts", "length_histogram", "lookup", "max_support_by_left", "mine", "mine_levels", "mine_pivot", "names",
    "pack_duplicates", "pack_items", "part_items", "pivot_intervals", "pivot_offsets", "positions", "rewrite", "save_encoded", "segments", "total_support",
    "two_sequence_postings", "with_ids", "word_count", "write_dictionary", "write_encoded_patterns", "write_encoded_text", "write_patterns",
]
