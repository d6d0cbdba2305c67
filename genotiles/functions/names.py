"""Track paths and the names derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes a track name loses.
TRACK_SUFFIXES = (".bigWig", ".bigwig", ".bw", ".bedGraph", ".bedgraph")

# Strand spellings.
PLUS_STRANDS = ("+", "plus", "forward", "1")
MINUS_STRANDS = ("-", "minus", "reverse", "-1")


def clean_path(path: Column) -> Column:
    """Requested path without surrounding blanks and quotes."""
    return F.btrim(F.btrim(F.btrim(path, F.lit(" \t\r\n")), F.lit('"')), F.lit("'"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def is_minus_strand(path: Column) -> Column:
    """Minus-strand track, told from the file name without its last suffix."""
    stem = F.lower(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", ""))
    return stem.endswith("_minus") | stem.endswith("-minus") | stem.contains(".minus")


def track_stem(path: Column, track_index: Column) -> Column:
    """File-safe track name before repeats are told apart."""
    suffixes = "|".join(s.replace(".", r"\.") for s in TRACK_SUFFIXES)
    fallback = F.concat(F.lit("track"), track_index.cast("string"))
    name = base_name(F.coalesce(F.when(path != "", path), fallback))
    safe = F.regexp_replace(F.regexp_replace(name, f"({suffixes})$", ""), r"[^\p{L}\p{N}._-]", "_")
    return F.when(safe == "", fallback).otherwise(safe)


def strand_sign(strand: Column) -> Column:
    """``+``, ``-`` or NULL for a strand in any known spelling."""
    spelled = F.lower(F.trim(strand))
    return F.when(spelled.isin(*PLUS_STRANDS), "+").when(spelled.isin(*MINUS_STRANDS), "-")
