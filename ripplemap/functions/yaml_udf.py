"""The one Python step: loading YAML text, Arrow batch by Arrow batch.

The functions only turn a text into typed rows, or JSON, or an error name. Which steps and
variables count, how they are named and which duplicate wins is decided in DataFrame code.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the package can still be imported; YAML operators then fail clearly
    yaml = None

STEPS_TYPE = (
    "steps array<struct<pos:int,name:string,step_type:string,command:string>>, error string"
)
VARIABLES_TYPE = "document string, error string"
# Sections of a variable file (the later overrides the earlier), and how
# deep nested keys are joined with dots.
VARIABLE_SECTIONS = ("root", "default_schema_names")
VARIABLE_DEPTH = 3


def _load(text: str):
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    return yaml.load(text, Loader=loader)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _steps(text: str) -> list[dict]:
    return [
        {
            "pos": pos,
            "name": _text(step.get("name")),
            "step_type": _text(step.get("step_type")),
            # A command that is no text but counts as given is kept as an unusable one.
            "command": _text(step.get("command")) if step.get("command") else "",
        }
        for pos, step in enumerate(_load(text)["steps"])
    ]


def _pairs(mapping: dict, depth: int = 1) -> list:
    """A mapping in its order: [key, text of a value, pairs of a mapping], one of the two null."""
    out = []
    for key, value in mapping.items():
        nested = isinstance(value, dict) and depth < VARIABLE_DEPTH
        if not isinstance(key, str):
            if depth > 1 or (nested and value):  # a key that cannot be joined with a dot
                raise TypeError(f"{key!r} is no text")
        elif nested:
            out.append([key, None, _pairs(value, depth + 1)])
        else:
            out.append([key, str(value), None])
    return out


def _document(text: str) -> str:
    """The sections of a variable file as JSON that keeps the order of keys."""
    document = _load(text)
    return json.dumps([_pairs(dict(document[section])) for section in VARIABLE_SECTIONS])


def _apply(texts: pd.Series, column: str, parse) -> pd.DataFrame:
    values, errors = [], []
    for text in texts:
        if text is None:  # no pipeline definition, nothing to load
            values.append(None)
            errors.append(None)
            continue
        try:
            values.append(parse(text))
            errors.append(None)
        except Exception as exc:  # any bad file becomes one quarantined row
            values.append(None)
            errors.append(type(exc).__name__)
    return pd.DataFrame({column: pd.Series(values, dtype=object),
                         "error": pd.Series(errors, dtype=object)})


def load_steps(text: Column) -> Column:
    """struct(steps, error) of a pipeline definition."""
    _need_yaml()

    @F.pandas_udf(STEPS_TYPE)
    def yaml_steps(texts: pd.Series) -> pd.DataFrame:
        return _apply(texts, "steps", _steps)

    return yaml_steps(text)


def load_variables(text: Column) -> Column:
    """struct(document, error) of a variable file; the document is JSON."""
    _need_yaml()

    @F.pandas_udf(VARIABLES_TYPE)
    def yaml_variables(texts: pd.Series) -> pd.DataFrame:
        return _apply(texts, "document", _document)

    return yaml_variables(text)


def _need_yaml() -> None:
    if yaml is None:
        raise ImportError("reading YAML needs the PyYAML package on driver and executors")
