"""Byte-pair ids of texts of any kind and length."""

from __future__ import annotations

import re

import regex

#: White space that makes the tokenizer's own matching, which tracks back, run out of stack when it is long.
RUN = re.compile(r"\s{20000,}")


def encode(encoding, text: str) -> list[int]:
    """The ids of a text by a tiktoken encoding, its special strings taken as text.

    Where white space runs long, the text is cut by the encoding's own pattern, but with a matcher that needs no stack for
    it, and each part is merged by itself, as the tokenizer does; a test compares the ids."""
    if not RUN.search(text):
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part in regex.finditer(encoding._pat_str, text):
        ids += encoding._encode_single_piece(part[0])
    return ids
