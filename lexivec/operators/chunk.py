"""Splitting texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.config import DEFAULT, Config
from lexivec.functions import bytepairs
from lexivec.functions import text as T


def token_windows(docs: DataFrame, size: int, overlap: float, least: int = DEFAULT.min_chunk_tokens) -> DataFrame:
    """(chunk_id, doc_id, ordinal, token_count, tokens) of docs (doc_id, text): windows of size tokens that overlap.

    The last window is the one that reaches the end. Windows under `least` tokens are dropped and leave a gap in the
    ordinals; a text without tokens has no chunk."""
    step = size - int(size * overlap)
    tokened = docs.select("doc_id", T.tokens(F.col("text")).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.ceil((F.size("all") - size) / step), F.lit(0)).cast("int")
    # The windows are cut before they are dealt out, so that no row carries the whole document with each of them.
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("all", i * step + 1, F.lit(size)))
    cut = tokened.select("doc_id", F.posexplode(parts).alias("ordinal", "tokens"))
    cut = cut.withColumn("token_count", F.size("tokens")).where(F.col("token_count") >= least)
    return cut.select(T.chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", "token_count", "tokens")


_TOKEN = re.compile(T.TOKEN)
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, count=lambda s: len(_TOKEN.findall(s)), separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size tokens, cut at paragraphs if possible, else at lines, spaces or characters; each begins with
    up to overlap tokens of whole parts of the one before. Lengths are counted once for each part."""
    at = next((i for i, s in enumerate(separators) if s and s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total, between = 0, count(mark) if mark else 0
    for part in parts:
        n = count(part)
        if n > size and finer:
            if held:
                out.append(mark.join(p for p, _ in held))
                held, total = [], 0
            out += split_text(part, size, overlap, count, finer)
            continue
        if held and total + between + n > size:
            out.append(mark.join(p for p, _ in held))
            while held and (total > overlap or total + between + n > size):
                total -= between * (len(held) > 1) + held.pop(0)[1]
        total += n + between * bool(held)
        held.append((part, n))
    if held:
        out.append(mark.join(p for p, _ in held))
    return [p.strip() for p in out if p.strip()]


def words_counted() -> Callable[[str], int]:
    """A counter of this library's tokens."""
    return lambda s: len(_TOKEN.findall(s))


def byte_pairs_counted(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[], Callable[[str], int]]:
    """A counter of byte-pair tokens, from a file of ranks and the pattern that its vocabulary cuts texts with."""

    def load() -> Callable[[str], int]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens=special or {})
        return lambda s: len(bytepairs.encode(encoding, s))

    return load


def recursive_chunks(docs: DataFrame, config: Config = DEFAULT, load_counter: Callable[[], Callable[[str], int]] = words_counted) -> DataFrame:
    """(chunk_id, doc_id, text, token_count, ordinal) of docs (doc_id, text) by split_text; small chunks leave gaps.

    load_counter gives the function that counts tokens of a text; it is called once in each worker."""
    if config.chunk_strategy != "recursive":
        raise ValueError(f"chunk strategy {config.chunk_strategy!r} is not implemented")
    size, overlap, least = config.chunk_tokens, config.overlap_tokens, config.min_chunk_tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load_counter()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for i, piece in enumerate(split_text(text, size, overlap, count)):
                    n = count(piece)
                    if n >= least:
                        rows.append((f"{doc_id}#{i:04d}", doc_id, piece, n, i))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "text", "token_count", "ordinal"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "chunk_id string, doc_id string, text string, token_count int, ordinal int")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Count, mean, least and most tokens; zeros where there are no chunks."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("mean_tokens"),
        F.coalesce(F.min("token_count"), F.lit(0)).cast("bigint").alias("min_tokens"), F.coalesce(F.max("token_count"), F.lit(0)).cast("bigint").alias("max_tokens"),
    )
