"""Predicates and labels of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Defaults of the quality rules.
MIN_CHARS, MAX_CHARS, MAX_CONTROL, MAX_REPLACEMENT, MAX_REPETITION = 200, 2_000_000, 0.01, 0.001, 0.35

#: What counts as personal data or a secret.
EMAIL = r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9.-])"
#: The word before `is`, `:` or `=` begins where no letter, digit or underscore of any script stands before it. Java looks back by
#: half a character at letters beyond U+FFFF, so the pattern takes what stands before instead.
SECRET = r"""(?i)(?:^|[^\p{L}\p{Nd}_])(?:password|passwd|pwd|api[ _-]?key|access[ _-]?token|auth[ _-]?token|secret)(?:\s+is\s+|\s*[:=]\s*)["']?[^\s<>{}"']{4,}"""
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?i)(?:^|[^\p{L}\p{Nd}_])(?:phone|mobile|telephone|tel)(?:\s+is\s+|\s*[:=]\s*)\+?\d[\d ().-]{7,}\d"
CARD = r"((?<!\d)(?:\d[ -]?){12,18}\d(?!\d))"

#: Signs of source code, of which two make a text code-like.
CODE_SIGNS = (
    r"(?m)^\s*(def|class|import|from|function|interface)\s+\w+",
    r"(?m)^\s*(const|let|var)\s+\w+\s*=",
    r"(?m)[{};]\s*(//.*)?$",
    r"(?m)^\s*#(include|define|!/)",
)
CODE_SAMPLE = 16_384
#: File suffixes and words of a provenance that mean source code.
CODE_SUFFIXES = "c cc cpp cs css go h hpp html java js jsx kt php py rb rs sh sql swift ts tsx vue".split()
CODE_HINTS = ("codeparrot", "github", "starcoder", "the-stack", "source-code")


def with_reject_reason(df: DataFrame, text: str = "text", out: str = "reject_reason", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, max_control: float = MAX_CONTROL, max_repetition: float = MAX_REPETITION) -> DataFrame:
    """df with the first quality rule that a text breaks, null if none. The length cap is tested on the raw text, the rest on the stripped one.

    The stripped text and its long lines are bound once, so that no rule makes them again.
    """

    def rules(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        marks = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
        share = tx.let(tx.long_lines(t), tx.repeated_share)
        return F.when(F.length(t) < min_chars, "too_short").when(tx.controls(t) / n > max_control, "control_characters").when(marks / n > MAX_REPLACEMENT, "replacement_characters").when(share > max_repetition, "repetitive")

    raw = F.col(text)
    return df.withColumn(out, F.when(F.length(raw) > max_chars, "too_long").otherwise(tx.let(tx.unix_lines(raw), rules)))


def code_like(text: Column, source: Column, provenance: Column | None = None) -> Column:
    """Source code by the source's file suffix (of its path, if it is a URL), a hint in source or other provenance, or two signs in the text's first characters."""
    sample = F.substring(text, 1, CODE_SAMPLE)
    signs = reduce(lambda a, b: a + b, [F.coalesce(sample.rlike(p).cast("int"), F.lit(0)) for p in CODE_SIGNS])
    # All signs but the first hold one of these characters, and looking for them takes a small part of the patterns' time.
    signs = F.when(reduce(lambda a, b: a | b, [F.contains(sample, F.lit(x)) for x in "={};#"]), signs).otherwise(0)
    path = F.when(source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(source, r"^[^:]*://[^/?#]*([^?#]*)", 1)).otherwise(source)
    file = path.rlike(rf"(?i)[^/]\.({'|'.join(CODE_SUFFIXES)})$")
    hint = F.lower(F.concat_ws(" ", source, *([] if provenance is None else [provenance]))).rlike("|".join(CODE_HINTS))
    return F.coalesce(file, F.lit(False)) | F.coalesce(hint, F.lit(False)) | (signs >= 2)


def privacy_reasons(text: Column) -> Column:
    """Sorted reason codes found in a text. A card number passes the Luhn check and isn't one digit repeated."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(CARD), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    card = F.exists(digits, lambda x: F.call_function("luhn_check", x) & ~x.rlike(r"^(\d)\1*$"))
    found = [F.when(text.rlike(EMAIL), "email"), F.when(text.rlike(PHONE), "labeled_phone"), F.when(text.rlike(SECRET), "labeled_secret"), F.when(card, "payment_card"), F.when(text.rlike(SSN), "ssn")]
    return F.array_compact(F.array(*found))


def bounded_label(label: Column, size: int = 160) -> Column:
    """Labels of up to `size` characters; longer ones are cut and end in a hash of the whole."""
    name = F.when(F.trim(label) == "", "unknown").otherwise(F.trim(label))
    return F.when(F.length(name) <= size, name).otherwise(F.concat(F.substring(name, 1, size - 22), F.lit("…#"), F.substring(F.sha2(name, 256), 1, 20)))


def source_family(source: Column) -> Column:
    """Provenance collapsed to a dataset, web host, scheme, file suffix or name."""
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(source, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    dataset = F.regexp_extract(source, r"^hf://datasets/+([^/?#]+(?:/+[^/?#]+)?)", 1)
    suffix = F.lower(F.regexp_extract(source, r"[^/\\.](\.[^./\\]+)$", 1))
    return bounded_label(
        F.when((scheme == "hf") & (host == "datasets"), F.concat(F.lit("dataset:"), F.when(dataset == "", "unknown").otherwise(dataset)))
        .when(scheme.isin("http", "https"), F.concat(F.lit("web:"), F.when(host == "", "unknown").otherwise(host)))
        .when(scheme != "", F.concat(F.lit("scheme:"), scheme))
        .when(source.rlike(r"[/\\]"), F.concat(F.lit("file:"), F.when(suffix == "", "no-extension").otherwise(suffix)))
        .otherwise(F.concat(F.lit("named:"), source))
    )


def exclude_groups(df: DataFrame, group: str, reasons: Column) -> DataFrame:
    """Rows of groups in which no row has a reason; a null group is one too."""
    bad = df.filter(F.size(reasons) > 0).select(F.col(group).alias("_group")).distinct()
    return df.join(bad, F.col(group).eqNullSafe(F.col("_group")), "left_anti")
