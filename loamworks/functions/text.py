"""Text forms and hashes as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

HASH_DIGITS = 15


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once a row, wherever the optimizer moves the expression (as into a filter)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_lines(text: Column) -> Column:
    """CRLF and CR become LF; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Squeezed text in lower case, character by character: what a part of a text becomes doesn't depend on what stands around it, as a final sigma's would."""
    return F.lower(F.translate(squeeze(text), "Σİ", "σi"))


def tokens(text: Column) -> Column:
    """Lower-cased words, and every other non-space character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


#: Latin-1: signs that are tokens by themselves, the common and the rare ones, and white space beyond ASCII. Java's words, and its white space, are these characters' others.
_SIGNS = [bytes([x]) for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "_"]
_RARE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7]")
_SPACES = re.compile("[\x85\xa0]")
_BEYOND = re.compile("[^\x00-\xff]")


def token_text(text: Column) -> Column:
    """What token_bytes() makes a text's joined tokens of: the text itself, or its tokens() where it has characters beyond Latin-1."""
    return F.when(text.rlike(r"[^\x00-\xff]"), F.array_join(tokens(text), " ")).otherwise(text)


def token_bytes(given: str | None) -> bytes:
    """A text's tokens() joined by spaces, in UTF-8, of its token_text(); tokens so joined stay as they are."""
    if not given or _BEYOND.search(given):
        return (given or "").encode()
    lower = given.lower()
    if not lower.isascii():
        lower = _SPACES.sub(" ", lower)
    if _RARE.search(lower):
        lower = _RARE.sub(r" \g<0> ", lower)
    data = lower.encode()
    for x in _SIGNS:
        if x in data:
            data = data.replace(x, b" " + x + b" ")
    return b" ".join(data.split())


def long_lines(text: Column, min_length: int = 20) -> Column:
    """Squeezed, lower-cased lines of at least min_length characters."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(squeeze(x))), lambda x: F.length(x) >= min_length)


def repeated_share(lines: Column) -> Column:
    """1 - distinct / all of an array; 0 where it is empty."""
    return F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0))


def controls(text: Column) -> Column:
    """Code points below 32 other than newline and tab."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""))


def digest(text: Column) -> Column:
    """sha256 of the squeezed text; case counts."""
    return F.sha2(squeeze(text), 256)


def hash60(*parts: Column) -> Column:
    """The first 15 hex digits of sha256 of the parts joined by ':'. Non-negative, and the same in any engine."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, HASH_DIGITS), 16, 10).cast("long")


def shingles(toks: Column, size: int) -> Column:
    """Distinct shingles of `size` tokens as space-joined strings; fewer tokens make one shingle, none makes none."""
    n = F.size(toks)
    count = F.greatest(n - (size - 1), F.lit(0))
    # Shifted copies are zipped, so that no lambda holds (and evaluates again) the tokens themselves.
    wins = F.slice(toks, 1, count)
    for j in range(2, size + 1):
        wins = F.zip_with(wins, F.slice(toks, j, count), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(n >= size, F.array_distinct(wins)).when(n > 0, F.array(F.array_join(toks, " "))).otherwise(F.array().cast("array<string>"))


def with_shingles(df: DataFrame, size: int, text: str = "text", out: str = "s") -> DataFrame:
    """df with the shingles of a text column. Tokens are a column of their own first, so that they are made once a row."""
    return df.withColumn("_tokens", tokens(F.col(text))).withColumn(out, shingles(F.col("_tokens"), size)).drop("_tokens")


#: Characters that a Python function works on and gives back at a time.
PIECE = 1 << 20


def pieces(texts: pd.Series) -> Iterator[list]:
    """The texts in lists of about PIECE characters, so that what is made of them doesn't grow with the batch."""
    part, held = [], 0
    for x in texts:
        part.append(x)
        held += len(x or "")
        if held >= PIECE:
            yield part
            part, held = [], 0
    if part:
        yield part


def shingle_hashes(joined: str | bytes | None, size: int) -> np.ndarray:
    """The first 64 bits of the sha256 of each distinct shingle of a text given as its tokens joined by spaces, in no order.

    A shingle is a stretch of that text, so none is put together.
    """
    data = joined if isinstance(joined, bytes) else (joined or "").encode()
    if not data:
        return np.zeros(0, ">i8")
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) + 1 < size:
        return np.frombuffer(sha256(data).digest()[:8], ">i8")
    starts, ends = np.append(0, gaps + 1)[: len(gaps) + 2 - size].tolist(), np.append(gaps, len(data))[size - 1 :].tolist()
    return np.frombuffer(b"".join([sha256(x).digest()[:8] for x in {data[a:b] for a, b in zip(starts, ends)}]), ">i8")


def hashed_shingles(text: Column, size: int) -> Column:
    """The 64-bit hashes of a text's distinct shingles (of shingles()), sorted as signed numbers.

    Making and hashing them as column functions takes several times as long, hence the UDF.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def hashes(joined: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in joined:
            for part in pieces(batch):
                yield pd.Series([np.sort(shingle_hashes(x, size).astype(np.int64)) for x in part])

    return hashes(F.array_join(tokens(text), " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC normalisation, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical_prompt(text: Column) -> Column:
    """Prompt comparison form: NFKC, lower case, squeezed."""
    return squeeze(F.lower(nfkc(text)))
