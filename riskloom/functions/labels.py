"""Class ids, label strings and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label string to class id, and the two display styles.
LABEL_TO_CLASS = {"non-suicide": 0, "suicide": 1}
DISPLAY = {0: "Not Suicidal", 1: "Suicidal"}


def class_of(label: Column, mapping: dict[str, int] | None = None) -> Column:
    """Class id of a label, null where the label is not in the map."""
    chain = None
    for name, value in (mapping or LABEL_TO_CLASS).items():
        chain = F.when(label == name, F.lit(value)) if chain is None else chain.when(label == name, F.lit(value))
    return chain


def label_of(cls: Column) -> Column:
    return F.when(cls == 1, "suicide").otherwise("non-suicide")


def display_of(cls: Column) -> Column:
    return F.when(cls == 1, DISPLAY[1]).otherwise(DISPLAY[0])
