"""Raw SQL, pinned: only declared statements run, with checked parameters and a checked result shape."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import DeclarationError, QueryError


def markers(text: str) -> set[str]:
    """Named parameter markers outside of quotes and comments."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    return set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare))


@dataclass(frozen=True)
class Statement:
    name: str
    text: str
    schema: T.StructType | None
    params: frozenset[str]

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


class Registry:
    """Declared statements by name. `prepare` analyses each against the session, without running it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.statements: dict[str, Statement] = {}
        self.pinned: set[str] = set()

    def declare(self, name: str, text: str, schema: str | T.StructType | None = None, params: tuple[str, ...] = ()) -> Statement:
        if name in self.statements:
            raise DeclarationError(f"the statement {name} is declared twice")
        found = markers(text)
        if found != set(params):
            raise DeclarationError(f"{name} has the markers {sorted(found)} and declares {sorted(params)}")
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        s = Statement(name, text, kind, frozenset(params))
        self.statements[name] = s
        self.pinned.add(s.digest)
        return s

    def prepare(self, samples: dict[str, dict[str, Any]] | None = None) -> None:
        """Compares what each query gives with its declared schema: names, order and types."""
        problems = []
        for s in self.statements.values():
            if s.schema is None:
                continue
            args = (samples or {}).get(s.name, dict.fromkeys(s.params))
            found = self.spark.sql(s.text, args=args).schema if s.params else self.spark.sql(s.text).schema
            have, want = ([(f.name, f.dataType) for f in x] for x in (found, s.schema))
            if have != want:
                problems.append(f"{s.name} gives {found.simpleString()} and declares {s.schema.simpleString()}")
        if problems:
            raise DeclarationError(problems)

    def query(self, name: str, **params: Any) -> DataFrame:
        s = self._checked(name, params)
        if s.schema is None:
            raise QueryError(f"{name} gives no rows")
        return self.spark.sql(s.text, args=params) if params else self.spark.sql(s.text)

    def one(self, name: str, **params: Any):
        return self.query(name, **params).limit(1).first()

    def execute(self, name: str, **params: Any) -> None:
        """A statement without rows."""
        s = self._checked(name, params)
        self.spark.sql(s.text, args=params) if params else self.spark.sql(s.text)

    def run_text(self, text: str, **params: Any) -> DataFrame:
        """Text from elsewhere runs only if it was declared."""
        if hashlib.sha256(text.encode()).hexdigest() not in self.pinned:
            raise QueryError("this statement was not declared")
        return self.spark.sql(text, args=params) if params else self.spark.sql(text)

    def _checked(self, name: str, params: dict) -> Statement:
        if name not in self.statements:
            raise QueryError(f"no statement {name}")
        s = self.statements[name]
        if set(params) != s.params:
            raise QueryError(f"{name} takes {sorted(s.params)}")
        return s
