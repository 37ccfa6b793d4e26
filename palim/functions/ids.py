"""Deterministic identifiers as SQL expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID (version 5) of a text."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


EPISODE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "palim:episode")


def episode_id(conversation: Column, start_seq: Column) -> Column:
    return uuid5(EPISODE_NAMESPACE, F.concat(conversation, F.lit(":"), start_seq.cast("string")))
