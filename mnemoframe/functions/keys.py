"""Content keys, secrets and specs."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import json
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names whose values never enter a key or a manifest. Matched whole, so that token budgets, on
#: which results depend, stay in keys.
SECRETS = {"api_key", "base_url", "password", "secret", "authorization", "access_token"}
#: Names of places on a machine, on which no result depends.
PLACES = {"cache_dir", "vector_dir", "context_dir", "output_dir"}


def content_key(*cols: str | Column) -> Column:
    """SHA-256 of the columns as JSON, in the order given, nulls kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def jsonable(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return jsonable(dataclasses.asdict(value))
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [jsonable(v) for v in value]
    if isinstance(value, set | frozenset):
        return sorted((jsonable(v) for v in value), key=str)
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def redacted(value: Any, drop: frozenset[str] | set[str] = frozenset()) -> Any:
    """value without secrets, and without the names in drop, at any depth."""
    value = jsonable(value)
    if isinstance(value, dict):
        return {k: redacted(v, drop) for k, v in value.items() if k.lower() not in SECRETS and k not in drop}
    return [redacted(v, drop) for v in value] if isinstance(value, list) else value


def stable_hash(value: Any, length: int = 16) -> str:
    text = json.dumps(jsonable(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:length]


class Undeclared(TypeError):
    """A component whose results can't be told from another's."""


@dataclasses.dataclass(frozen=True)
class Declared:
    """A function with the identity that it is cached by: a name, a version, and the settings that
    its results depend on."""

    run: Callable[..., Any]
    name: str
    version: str
    settings: dict[str, Any] = dataclasses.field(default_factory=dict)

    def __call__(self, *args: Any, **named: Any) -> Any:
        return self.run(*args, **named)

    def cache_spec(self) -> dict[str, Any]:
        return {"name": self.name, "version": self.version, "settings": self.settings}


def identity(thing: Any, strict: bool = True) -> Any:
    """What results depend on in a component, as JSON values that are equal in every process. An
    object says so itself (cache_spec), or is a dataclass of settings; a function is known by its
    module and name, and its `version` if it has one; partials and methods by their parts. Closures,
    lambdas, functions of a script and other objects have none: they are refused, or, if not strict,
    known by their kind alone, which no cache may rely on. Secrets and places take no part."""
    if thing is None or isinstance(thing, str | int | float | bool):
        return thing
    if isinstance(thing, dict):
        return {str(k): identity(v, strict) for k, v in thing.items() if str(k).lower() not in SECRETS and k not in PLACES}
    if isinstance(thing, list | tuple):
        return [identity(x, strict) for x in thing]
    if isinstance(thing, set | frozenset):
        return sorted((identity(x, strict) for x in thing), key=str)
    own = f"{type(thing).__module__}.{type(thing).__qualname__}"
    if callable(spec := getattr(thing, "cache_spec", None)) and not isinstance(thing, type):
        said = spec()
        if not isinstance(said, dict):
            raise TypeError(f"cache_spec() of {own} must give a dict")
        return {"of": own, "spec": identity(said, strict)}
    if isinstance(thing, functools.partial):
        return {"of": identity(thing.func, strict), "args": identity(thing.args, strict), "named": identity(thing.keywords, strict)}
    if isinstance(thing, types.MethodType):
        return {"of": identity(thing.__self__, strict), "method": thing.__name__}
    if isinstance(thing, types.FunctionType | types.BuiltinFunctionType | type):
        name = f"{thing.__module__}:{thing.__qualname__}"
        if "<" in name or thing.__module__ in (None, "__main__"):
            if strict:
                raise Undeclared(f"{name} has no identity to be cached by; wrap it in Declared(run, name, version)")
            return {"undeclared": name}
        return {"function": name, "version": identity(getattr(thing, "version", None), strict)}
    if dataclasses.is_dataclass(thing):
        return {"of": own, "fields": identity({f.name: getattr(thing, f.name) for f in dataclasses.fields(thing)}, strict)}
    if strict:
        raise Undeclared(f"{own} has no identity to be cached by; give it cache_spec()")
    return {"undeclared": own}


def config_key(config: Any, strict: bool = True) -> str:
    return stable_hash(identity(config, strict), 64)


def artifact_ids(units: DataFrame, system: str, config: Any, strict: bool = False) -> DataFrame:
    """(scope_id, artifact_id, unit_count): what a scope's units and the config add up to. Each
    unit is hashed on its own, so that only digests are gathered."""
    held = units.groupBy("scope_id").agg(F.sort_array(F.collect_list(content_key(*[c for c in units.columns if c not in ("ts", "available_at")]))).alias("h"), F.count("*").alias("unit_count"))
    key = F.substring(F.sha2(F.concat_ws("|", F.lit(config_key(config, strict)), F.col("scope_id"), F.array_join("h", "")), 256), 1, 16)
    return held.select("scope_id", F.concat(F.lit(f"{system}:"), key).alias("artifact_id"), "unit_count")
