"""User extensions: scalar functions, functional forms, aggregates and datatypes by IRI."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass
class Registry:
    """``functions``: IRI to a builder from TERM columns to a TERM column (NULL is an error).

    A function is not called where an argument is unbound or in error; a ``form`` sees such
    arguments as NULL. ``aggregates``: IRI to a builder from a TERM column to an aggregate TERM column.
    ``datatypes``: IRI to a builder from a lexical column to the column its values are compared by.
    """

    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    forms: dict[str, Callable[..., Column]] = field(default_factory=dict)
    aggregates: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    datatypes: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
