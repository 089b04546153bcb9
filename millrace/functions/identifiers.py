"""Sortable ids, table names and secret masking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base-32 digits of a sortable id (no I, L, O, U) and its shape.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ID_PATTERN = "^[a-z]{2,6}_[0-9A-HJKMNP-TV-Z]{26}$"

NAME_LIMIT = 63


def is_id(value: Column, prefix: str | None = None) -> Column:
    shaped = F.coalesce(value.rlike(ID_PATTERN), F.lit(False))
    return shaped if prefix is None else shaped & value.startswith(prefix + "_")


def id_prefix(value: Column) -> Column:
    return F.when(is_id(value), F.split_part(value, F.lit("_"), F.lit(1)))


def id_body(value: Column) -> Column:
    return F.when(is_id(value), F.split_part(value, F.lit("_"), F.lit(2)))


def id_timestamp_ms(value: Column) -> Column:
    """Creation time held in the first ten digits; NULL when it is no id."""
    body = id_body(value)
    return F.aggregate(
        F.split(F.substring(body, 1, 10), ""),
        F.lit(0).cast("bigint"),
        lambda total, char: total * 32 + _digit(char),
    )


def _digit(char: Column) -> Column:
    return (F.position(char, F.lit(BASE32)) - 1).cast("bigint")


def slugify(name: Column) -> Column:
    """A name that is safe as a table name: lower case, digits and single underscores.

    A name with nothing usable becomes ``x`` and four hash digits, so equal
    inputs stay equal.  A name that is too long is cut and ends in eight hash
    digits of the whole, so different long names stay different.
    """
    text = F.trim(F.lower(name))
    joined = F.regexp_replace(text, "[^a-z0-9]+", "_")
    bare = F.regexp_replace(joined, "^_+|_+$", "")
    named = F.when(
        bare == "", F.concat(F.lit("x"), F.substring(F.md5(name), 1, 4))
    ).otherwise(bare)
    started = F.when(named.rlike("^[0-9]"), F.concat(F.lit("t_"), named)).otherwise(named)
    cut = F.regexp_replace(F.substring(started, 1, NAME_LIMIT - 9), "_+$", "")
    hashed = F.concat(cut, F.lit("_"), F.substring(F.md5(started), 1, 8))
    return F.when(F.length(started) > NAME_LIMIT, hashed).otherwise(started)


def slug(text: str) -> str:
    """``slugify`` for a single name on the driver, such as a stream or model name."""
    bare = re.sub("[^a-z0-9]+", "_", text.strip().lower()).strip("_")
    if not bare:
        bare = "x" + hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:4]
    name = f"t_{bare}" if bare[:1].isdigit() else bare
    if len(name) <= NAME_LIMIT:
        return name
    digits = hashlib.md5(name.encode(), usedforsecurity=False).hexdigest()[:8]
    return f"{name[: NAME_LIMIT - 9].rstrip('_')}_{digits}"


def mask_secrets(config: Column, secret_keys: Iterable[str]) -> Column:
    """Replace non-empty secret values of a string map by ``***``."""
    keys = list(secret_keys)
    return F.transform_values(
        config, lambda k, v: F.when(k.isin(keys) & (v != ""), F.lit("***")).otherwise(v)
    )
