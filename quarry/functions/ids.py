"""Identities of documents, chunks and images; all can be recomputed in SQL."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's sha256."""
    return F.substring(F.sha2(value.cast("binary"), 256), 1, digits)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), short_hash(content, 16))


def draft_chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    """The id of a chunk before its text is refined."""
    return F.concat(doc_id, F.lit("_"), F.lpad(index.cast("string"), 4, "0"), F.lit("_"), short_hash(text, 8))


def stored_chunk_id(doc_id: Column, source_path: Column, index: Column, text: Column) -> Column:
    """The id under which a chunk is stored: it changes with the path and the refined text."""
    return F.concat(doc_id, F.lit("_"), short_hash(source_path, 8), F.lit("_"), F.lpad(index.cast("string"), 4, "0"), F.lit("_"), short_hash(text, 8))


def image_id(doc_hash: Column, page: Column, sequence: Column) -> Column:
    return F.concat_ws("_", F.substring(doc_hash, 1, 8), page.cast("string"), sequence.cast("string"))


def fallback_document_id(source_ref: Column, doc_hash: Column, source_path: Column, chunk_id: Column) -> Column:
    """The first of reference, hash, path and chunk id that is there names the document."""

    def given(x: Column) -> Column:
        return F.nullif(F.trim(x), F.lit(""))

    return F.coalesce(
        given(source_ref),
        F.concat(F.lit("doc_"), F.substring(given(doc_hash), 1, 16)),
        F.concat(F.lit("doc_path_"), short_hash(given(source_path), 16)),
        F.concat(F.lit("doc_chunk_"), chunk_id),
    )


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


#: Words in a key's name that mark secrets and places.
SECRET = {"authorization", "credential", "credentials", "passwd", "password", "secret", "token"}
PLACE = {"dir", "directory", "endpoint", "file", "filepath", "folder", "path", "uri", "url"}


def key_words(key: object) -> list[str]:
    """The words of a key in snake, kebab or camel case, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+", str(key))]


def hidden_key(key: object) -> bool:
    """Whether a setting is a secret or a place, and so no part of an identity."""
    words = set(key_words(key))
    pair = any({a, "key"} <= words for a in ("api", "access", "private"))
    return bool(words & (SECRET | PLACE)) or pair or "".join(key_words(key)) in ("apikey", "accesstoken", "authtoken", "privatekey")


def settings_fingerprint(settings: Mapping) -> str:
    """sha256 of settings without secrets and places, so that equal indexes share it; what is left empty by that goes, too."""

    def visible(x: object) -> object:
        if isinstance(x, Mapping):
            kept = {str(k): visible(v) for k, v in x.items() if not hidden_key(k)}
            return {k: v for k, v in kept.items() if v != {}}
        return [visible(v) for v in x] if isinstance(x, list | tuple) else x

    return hashlib.sha256(canonical_json(visible(settings)).encode()).hexdigest()


def collection_name(provider: str, fingerprint: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", f"{provider}__{fingerprint[:12]}")


def deep_merge(base: Mapping, overrides: Mapping) -> dict:
    """``base`` with the overrides' leaves; both stay as they are."""
    out = dict(base)
    for key, value in overrides.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out
