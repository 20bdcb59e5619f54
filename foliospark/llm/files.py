"""Files that tasks write below the shared folder."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs

from ..session import qualified, scratch


def output_folder(spark, label: str) -> str:
    """A fresh folder as a complete URI, so that every executor means the same place."""
    return qualified(spark, scratch(spark, label))


def open_store(uri: str):
    """The file system of a URI, and the path in it."""
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return fs.FileSystem.from_uri(uri)


def own_name(prefix: str, suffix: str) -> str:
    """A name no other attempt of the same task uses; only names in a written manifest count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
