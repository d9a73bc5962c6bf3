"""Folders that belong to one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .batches import first_line, write_line

# What a folder says of itself; readers pass over names that begin so.
OWNER = "_owner"


def claim(spark: SparkSession, path: str, checkpoint: str, kind: str, has_rows: Callable[[], bool]) -> None:
    """Make the folder this stream's, or see that it is."""
    mine = [checkpoint.rstrip("/"), kind]
    owner = first_line(spark, f"{path}/{OWNER}")
    if owner is None:
        if first_line(spark, f"{checkpoint}/metadata") is not None:
            raise ValueError(f"the checkpoint {checkpoint} belongs to another folder than {path}")
        write_line(spark, f"{path}/{OWNER}", " ".join(x.encode().hex() for x in mine))
    elif [bytes.fromhex(x).decode() for x in owner.split(" ")] != mine:
        raise ValueError(f"{path} belongs to another stream")
    elif first_line(spark, f"{checkpoint}/metadata") is None and has_rows():
        raise ValueError(f"{path} holds rows of a checkpoint that is gone from {checkpoint}")
