"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of tokens, page furniture, citations and the abstention sentence.
TOKEN = r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*"
PAGE_FOOTER = r"^.*\[Page \d+\]\s*$"
PAGE_HEADER = r"^RFC \d{3,5}\s{2,}.*\b(19|20)\d{2}\s*$"
CITATION = r"\[(rfc\d+#\d+)\]"
CITATION_MARK = r"\s*\[rfc\d+#\d+\]"
ABSTENTION = "i don't have enough information in the provided context"
ABSTAIN_SENTENCE = "I don't have enough information in the provided context to answer that."
RETRY_PROSE = r"(?i)(?:retry|try again) in ([\d.]+)s"
RETRY_INFO = r"retryDelay'?:?\s*'?(\d+)s"
TRANSIENT = (
    "429", "rate limit", "resourceexhausted", "resource exhausted", "quota", "deadline", "timeout", "timed out", "503", "unavailable", "500", "internal error", "connection error",
    "connection reset", "connection aborted",
)
PARSE = ("failed to parse", "outputparser", "output_parsing", "validation error", "nonetype")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; hyphens and underscores inside them stay, so retry-after is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Unix line ends without byte order marks, page headers, page footers and form feeds, lines without trailing space, at most one blank
    line in a row, and one line end at the end."""
    unix = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\ufeff", ""), r"\r\n?", "\n"), "\f", "")
    lines = F.filter(F.split(unix, "\n", -1), lambda x: ~x.rlike(PAGE_FOOTER) & ~x.rlike(PAGE_HEADER))
    body = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.concat(strip(F.regexp_replace(body, r"\n{3,}", "\n\n")), F.lit("\n"))


def chunk_id(doc: Column, ordinal: Column) -> Column:
    return F.format_string("%s#%04d", doc.cast("string"), ordinal)


def doc_of(chunk: Column) -> Column:
    return F.substring_index(chunk, "#", 1)


def citations(text: Column, retrieved: Column) -> Column:
    """Ids cited in text that are in the array retrieved, each once, in the order of their first mention."""
    return F.array_intersect(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), retrieved)


def without_citations(text: Column) -> Column:
    return strip(F.regexp_replace(text, CITATION_MARK, ""))


def abstains(text: Column) -> Column:
    return F.startswith(F.lower(strip(text)), F.lit(ABSTENTION))


def context_block(chunks: Column) -> Column:
    """"[id]" and text of each element of array<struct<chunk_id, text>>, apart by blank lines."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("]\n"), c["text"])), "\n\n")


def prompt(question: Column, chunks: Column) -> Column:
    return F.concat(F.lit("Context passages:\n\n"), context_block(chunks), F.lit("\n\nQuestion: "), question)


def part_text(content: Column) -> Column:
    """Text of a JSON value: a string, or a list of strings and of objects with a text; anything else is empty."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("{")), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    return F.when(F.startswith(content, F.lit("[")), F.array_join(texts, "")).when(F.startswith(content, F.lit('"')), F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>")[0]).otherwise("")


def question_key(question: Column) -> Column:
    return F.substring(F.sha1(question), 1, 8)


def error_class(message: Column) -> Column:
    """transient, parse or fatal; the first two are worth a retry."""
    low = F.lower(message)

    def has(words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))

    return F.when(has(TRANSIENT), "transient").when(has(PARSE), "parse").otherwise("fatal")


def retry_delay(message: Column) -> Column:
    """Seconds that the server asks for, in prose before structured form; null if it asks for none."""

    def found(p: str) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(message, p, 1), F.lit("")), F.lit("999999999.999999")).cast("double")

    return F.coalesce(found(RETRY_PROSE), found(RETRY_INFO))


def backoff(delay: Column, attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.coalesce(delay + 1, F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))), F.lit(cap))


def outcome(text: Column) -> Column:
    return F.when(abstains(text), "abstained").otherwise("answered")


def utc(ts: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_now() -> Column:
    return utc(F.current_timestamp())


def shortened(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(text, F.lit(n))


def valid_question(question: Column, most: int = 2000) -> Column:
    """Whether a question has between 1 and `most` characters; false for null."""
    return F.coalesce(F.length(question).between(1, most), F.lit(False))
