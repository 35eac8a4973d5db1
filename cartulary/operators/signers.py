"""Signers of an act: variants of one person become one entry."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _words(name: str) -> frozenset[str]:
    """Words of a name of three letters or more, without accents, in capitals."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).upper()
    return frozenset(w for w in re.split(r"[^A-Z]+", plain) if len(w) >= 3)


def consolidate(signers: list[dict] | None) -> list[dict]:
    """One entry a person, in order of first sight: (name, role) of the first variant with a role, else of the first one.

    Two entries are one person when they share two words of the name, or when all words of one are in the other. A group knows the words of all
    its variants, so the order of the entries matters. Entries without a name go; nobody else does.
    """
    flat = lambda x: " ".join(str(x or "").split())
    people: list[tuple[set[str], list[dict]]] = []
    for s in signers or []:
        name, role = flat(s and s.get("name")), flat(s and s.get("role"))
        if not name or name.lower() == "unknown":
            continue
        entry, words = {"name": name, "role": "unknown" if role.lower() in ("", "unknown") else role}, _words(name)
        for known, variants in people:
            shared = words & known
            if len(shared) >= 2 or (shared and (words <= known or known <= words)):
                known |= words
                variants.append(entry)
                break
        else:
            people.append((set(words), [entry]))
    return [next((v for v in variants if v["role"] != "unknown"), variants[0]) for _, variants in people]


def consolidated(rows: DataFrame, column: str) -> DataFrame:
    """rows with a list of (name, role) consolidated; an act has few signers, so a list is handled as a whole."""
    at = rows.columns.index(column)
    kind = pa.list_(pa.struct([("name", pa.string()), ("role", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, column, pa.array([consolidate(x) for x in b.column(at).to_pylist()], kind))

    kinds = ", ".join(f"`{c}` {'array<struct<name: string, role: string>>' if c == column else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, kinds)
