"""Readers of sequence databases.

All give (sid, seq_id, items): sid is a row id that is unique per line, since a transaction is a line and ids in
the text may repeat. Lines without items are dropped.
"""

from .encoded import load_dictionary, load_encoded, read_encoded_text
from .tables import from_table, from_text_column
from .text import read_int_sequences, read_length_prefixed, read_sentences, read_sequences
from .timed import read_timed, timed_positions

__all__ = [
    "from_table", "from_text_column", "load_dictionary", "load_encoded", "read_encoded_text", "read_int_sequences",
    "read_length_prefixed", "read_sentences", "read_sequences", "read_timed", "timed_positions",
]
