"""Functions over JSON of unbounded depth, which no Catalyst expression can walk: Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that carry no text, fixed by the source format.
_SILENT = ("style", "br")


def plain_text(value: object) -> str | None:
    """Markup as JSON (element names as keys) in plain text: blank lines between elements, lines between repeated ones, '- ' before list items."""
    if isinstance(value, str):
        return value.strip() or None
    if value is None:
        return None
    if isinstance(value, list):
        return "\n".join(filter(None, map(plain_text, value))) or None
    if not isinstance(value, dict):
        return str(value)
    blocks = []
    for name, inner in value.items():
        if name == "li":
            texts = [plain_text(x) for x in (inner if isinstance(inner, list) else [inner])]
            blocks.append("\n".join("- " + t for t in texts if t))
        elif name not in _SILENT:
            blocks.append(plain_text(inner))
    return "\n\n".join(filter(None, blocks)) or None


def _loaded(text: str) -> object:
    """JSON text, or the bare string that a JSON reader has already unquoted."""
    if text[:1] in '{["' or text in ("true", "false", "null"):
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


@F.pandas_udf(T.StringType())
def flatten_markup(text: pd.Series) -> pd.Series:
    return text.map(lambda t: plain_text(_loaded(t)), na_action="ignore")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def flat_score(entry: dict, nested: str, drop: frozenset[str] = frozenset()) -> dict:
    """A score entry with its nested data beside its own fields, in snake case.

    `type` becomes assessment_type where the nested object is cvssData; ssvcData loses its id, and its options merge into the entry.
    """
    scoring = nested == "cvssData"
    own = {("assessment_type" if scoring and k == "type" else k): v for k, v in entry.items() if k != nested}
    data = dict(entry.get(nested) or {})
    if not scoring:
        data.pop("id", None)
        choices = data.pop("options", None) or []
        data |= {k: v for option in choices for k, v in option.items()}
    return {snake(k): v for k, v in (own | data).items() if k not in drop}


def flat_score_udf(nested: str, drop: tuple[str, ...] = ()):  # noqa: ANN201
    """JSON text of an entry to canonical JSON text of its flat form; identifiers hash this text."""
    dropped = frozenset(drop)

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(flat_score(json.loads(t), nested, dropped), sort_keys=True), na_action="ignore")

    return run
