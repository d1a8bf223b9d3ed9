"""String predicates and scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """ASCII lower case, as SQL LIKE folds."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_fold(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def has(c: Column, text: str) -> Column:
    """Case-insensitive (ASCII) literal substring."""
    return F.contains(fold(c), F.lit(ascii_fold(text)))


def under(path: Column, prefix: str) -> Column:
    return F.startswith(fold(path), F.lit(ascii_fold(prefix)))


def whole_word(c: Column, word: str) -> Column:
    return c.rlike(r"(?<![A-Za-z0-9_])" + re.escape(word) + r"(?![A-Za-z0-9_])")


def fts_safe(q: str) -> bool:
    return all(ch.isalnum() or ch in "_ " for ch in q)


def tokens(c: Column) -> Column:
    """' tok tok tok': lower-case words; everything but letters and digits separates."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")))


def query_tokens(q: str) -> str:
    return " ".join(t for t in re.split(r"[\W_]+", q.lower()) if t)


def phrase_prefix(c: Column, q: str) -> Column:
    """Consecutive tokens equal the query's, the last one as a prefix."""
    toks = query_tokens(q)
    return F.contains(tokens(c), F.lit(" " + toks)) if toks else F.lit(False)


def is_test_attribute(attributes: Column) -> Column:
    return F.exists(F.split(F.coalesce(attributes, F.lit("")), ", "), lambda a: F.trim(a).rlike(r"^(test|.*::test|test\(.*|rstest|rstest\(.*|test_case\(.*)$"))


def is_entry_point(name: Column, attributes: Column) -> Column:
    return (name == "main") | is_test_attribute(attributes)


def qualified(impl_type: Column, name: Column) -> Column:
    return F.when(impl_type.isNotNull(), F.concat(impl_type, F.lit("::"), name)).otherwise(name)


def split_qualified(name: str) -> tuple[str | None, str]:
    """(impl type, name) at the last `::`."""
    head, sep, tail = name.rpartition("::")
    return (head if sep else None), tail


def base_name(name: str) -> str:
    """What follows the first `::`."""
    return name.partition("::")[2] if "::" in name else name


def string_literal_with(body: Column, q: str) -> Column:
    """The first string literal that contains q, at most 100 characters."""
    found = F.filter(F.regexp_extract_all(body, F.lit(r'"((?:[^"\\]|\\.)+)"'), F.lit(1)), lambda s: has(s, q))
    return F.substring(F.get(found, F.lit(0)), 1, 100)


def first_line_with(body: Column, q: str) -> Column:
    return F.get(F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: (x != "") & has(x, q)), F.lit(0))


def matches_signature(signature: Column, wanted: str) -> Column:
    """A signature holds `wanted` up to a word end, or as a generic head, or one of its words as a suffix."""
    at = F.locate(wanted, signature)
    after = F.substring(signature, at + len(wanted), F.lit(1))
    exact = (at > 0) & ~after.rlike(r"[\p{L}\p{N}]")
    generic = F.lit(False)
    if wanted.endswith(">"):
        head = wanted[:-1]
        generic = F.substring(signature, F.locate(head, signature) + len(head), F.lit(1)).isin(",", ">") & (F.locate(head, signature) > 0)
    words = [w for w in re.split(r"[^A-Za-z0-9_]+", wanted) if len(w.encode()) >= 3]
    own = F.split(signature, r"[^A-Za-z0-9_]+")
    suffix = F.exists(own, lambda w: F.exists(F.array(*[F.lit(x) for x in words]), lambda f: F.endswith(w, f))) if words else F.lit(False)
    return exact | generic | suffix


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fnv1a(text: str) -> str:
    """64-bit FNV-1a as lower-case hexadecimal without padding."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:x}"


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / F.greatest(whole, F.lit(1)))).cast("long")
