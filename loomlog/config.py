"""Settings of a log: defaults, over them a JSON file, over that the environment."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class LogConfig:
    root: str = "log"
    remote: str | None = None
    segment_records: int = 1024
    read_only: bool = False
    most_records: int = 256
    most_bytes: int = 1 << 20
    tail_credit: int = 100
    poll_millis: int = 250

    @classmethod
    def load(cls, path: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = "LOOMLOG_") -> LogConfig:
        """Unknown names in the file, and values that are not of a setting's kind, are errors."""
        environ = os.environ if environ is None else environ
        given = {}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        fields = {f.name: f for f in dataclasses.fields(cls)}
        if odd := given.keys() - fields.keys():
            raise ValueError(f"unknown settings: {sorted(odd)}")
        given |= {n: environ[prefix + n.upper()] for n in fields if prefix + n.upper() in environ}
        return cls(**{n: cls._read(n, x, fields[n].default) for n, x in given.items()})

    @staticmethod
    def _read(name: str, value, default):
        if isinstance(default, bool):
            if str(value).lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"{name} is true or false")
            return str(value).lower() in ("true", "1")
        if isinstance(default, int):
            if int(value) <= 0:
                raise ValueError(f"{name} is above zero")
            return int(value)
        return value
