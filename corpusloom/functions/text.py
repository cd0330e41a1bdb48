"""Text expressions: stripping, chunk windows, token estimates, names, reasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from corpusloom.functions.binding import bind
from corpusloom.session import bounded_batches

# The characters that Python's ``str.strip`` removes.
WHITESPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(chr(code) for code in WHITESPACE_CODES)
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{code:x}}}" for code in WHITESPACE_CODES) + "]"

# Chunk size and overlap in tokens, and characters per token where
# no tokenizer is at hand.
CHUNK_TOKENS = 400
CHUNK_OVERLAP = 50
CHARS_PER_TOKEN = 4
# Lengths of shortened texts.
PREVIEW_CHARS = 300
SHA_PREFIX = 12

# Content types by lower-case file extension.
MIME_TYPES = {
    "ico": "image/x-icon",
    "gif": "image/gif",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "svg": "image/svg+xml",
    "css": "text/css",
    "js": "application/javascript",
    "json": "application/json",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "pdf": "application/pdf",
    "xml": "application/xml",
}
DEFAULT_MIME = "application/octet-stream"


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` removes blanks only).

    A trim on the right lists all characters of the text first, so only texts that end with white space get one.
    """

    def strip(t: Column) -> Column:
        ends = reduce(or_, [F.endswith(t, F.lit(c)) for c in WHITESPACE])
        return F.ltrim(F.when(ends, F.rtrim(t, F.lit(WHITESPACE))).otherwise(t), F.lit(WHITESPACE))

    return bind(text, strip)


def words(text: Column) -> Column:
    """White-space separated words of a text, without empty ones.

    Every white-space character becomes a blank first, since splitting by one fixed
    character needs no regular expression.
    """
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def char_windows(
    stripped: Column,
    size: int = CHUNK_TOKENS * CHARS_PER_TOKEN,
    step: int = (CHUNK_TOKENS - CHUNK_OVERLAP) * CHARS_PER_TOKEN,
) -> Column:
    """Windows of ``size`` characters at 0, step, 2*step, ... below the text length.

    A text of at most ``size`` characters is one window. The windows come from one
    look-ahead match, so the cost is linear in the text; cutting each window with
    ``substring`` would rescan the text from its start every time.
    """
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"
    return (
        F.when(F.length(stripped) == 0, F.array().cast("array<string>"))
        .when(F.length(stripped) <= size, F.array(stripped))
        .otherwise(F.regexp_extract_all(stripped, F.lit(pattern), F.lit(1)))
    )


def token_windows(tokens: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` tokens every ``size - overlap``; the first that reaches the end is last."""

    def windows(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(held) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(
            F.size(held) > 0, F.transform(starts, lambda i: F.slice(held, i + 1, F.lit(size)))
        ).otherwise(F.array())

    return bind(tokens, windows)


def word_windows(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Token windows where a token is a white-space separated word."""
    return F.transform(token_windows(words(text), size, overlap), lambda w: F.array_join(w, " "))


def tokenizer_windows(
    encode: Callable[[str], list[int]],
    decode: Callable[[list[int]], str],
    size: int = CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
) -> Callable[[Column], Column]:
    """Token windows for an injected tokenizer, as an Arrow-batched function."""

    def windows(text: str) -> list[str]:
        tokens = encode(text) if text else []
        if not tokens:
            return []
        if len(tokens) <= size:
            return [text]
        last = max(len(tokens) - overlap - 1, 0)
        return [decode(tokens[at : at + size]) for at in range(0, last + 1, size - overlap)]

    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(windows)

    return split


def tokenizer_count(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """Number of tokens of a text for an injected tokenizer; NULL text gives NULL."""

    bounded_batches(SparkSession.getActiveSession())

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return count


def estimate_tokens(text: Column) -> Column:
    """Tokens of one text without a tokenizer: a quarter of its length, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("bigint")


def preview(text: Column, size: int = PREVIEW_CHARS) -> Column:
    """The first characters of a text; the dots are always added."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(.)\.[^.]+$", "$1")


def title(name: Column, override: Column | None = None) -> Column:
    """Title override if it is not empty, else the file stem."""
    stem = file_stem(name)
    return stem if override is None else F.coalesce(F.nullif(override, F.lit("")), stem)


def sanitize_filename(name: Column, unsafe: str = r'[/\\:*?"<>|\x00-\x1f]', by: str = "_") -> Column:
    """Replace characters that are unsafe in file paths."""
    return F.regexp_replace(name, unsafe, by)


def file_extension(name: Column) -> Column:
    """Lower-case extension of a file name or URL path; empty if there is none."""
    path = F.regexp_replace(name, r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"[^/.]\.([A-Za-z0-9]+)$", 1))


def mime_type(name: Column, types: dict[str, str] | None = None, default: str = DEFAULT_MIME) -> Column:
    """Content type of a file name, by one mapping for all extensions."""
    pairs = [F.lit(part) for pair in (types or MIME_TYPES).items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), file_extension(name)), F.lit(default))


def replace_text(content: Column, pattern: str, replacement: str) -> Column:
    """Content with every match of a regular expression replaced."""
    return F.regexp_replace(content, pattern, replacement)


def render_template(template: str, **values: Column) -> Column:
    """Content built from a text with ``${name}`` places; a NULL value leaves the place empty."""
    parts: list[Column] = []
    rest = template
    while "${" in rest:
        head, _, tail = rest.partition("${")
        name, closed, rest = tail.partition("}")
        if not closed or name not in values:
            raise ValueError(f"no value for place ${{{name}}}")
        parts += [F.lit(head), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def short_sha(sha: Column) -> Column:
    """Digest shortened for messages."""
    return F.concat(F.substring(sha, 1, SHA_PREFIX), F.lit("..."))
