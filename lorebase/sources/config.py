"""Configuration: YAML in, dataclasses out, and back."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lorebase.tables import schema


@dataclass
class Topic:
    name: str
    query: str
    categories: list[str] = field(default_factory=list)
    research_profile: str = ""


@dataclass
class Models:
    filter_model: str = "small"
    reader_model: str = "large"
    embedding_model: str = "embedding"
    max_concurrent: int = 5
    temperature: float = 0.3
    api_key: str = ""


@dataclass
class Scraper:
    max_results_per_topic: int = 50
    delay_seconds: float = 3.0
    days_lookback: int = 7


@dataclass
class Filter:
    relevance_threshold: int = 6
    borderline_min: int = 4


@dataclass
class Config:
    topics: list[Topic] = field(default_factory=list)
    llm: Models = field(default_factory=Models)
    scraper: Scraper = field(default_factory=Scraper)
    filter: Filter = field(default_factory=Filter)
    db_path: str = "data/papers.db"
    vector_path: str = "data/vectors"
    pdf_dir: str = "data/pdfs"
    sota_dir: str = "data/sota"


def _scalar(text: str) -> Any:
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1].replace("''", "'") if t[0] == "'" else t[1:-1]
    if t in ("", "~", "null"):
        return None
    if t in ("true", "false"):
        return t == "true"
    if t in ("[]", "{}"):
        return [] if t == "[]" else {}
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def _quote(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''").replace("\n", " ") + "'"


def read_yaml(text: str) -> Any:
    """YAML by the library if it is installed, else the subset that configurations use: nested
    maps, lists of scalars and maps, scalars that go on over indented lines."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        rows: list[tuple[int, str]] = []
        for line in text.splitlines():
            if line.strip() and not line.strip().startswith("#"):
                rows.append((len(line) - len(line.lstrip()), line.strip()))
        value, _ = _block(rows, 0, -1)
        return value


def _is_item(t: str) -> bool:
    key = t[2:] if t.startswith("- ") else t
    head, colon, rest = key.partition(":")
    return t == "-" or t.startswith("- ") or bool(colon and (not rest or rest[0] == " ") and " " not in head.strip("'\""))


def _block(rows: list[tuple[int, str]], at: int, above: int) -> tuple[Any, int]:
    if at >= len(rows):
        return None, at
    indent = rows[at][0]
    out: Any = [] if rows[at][1].startswith("-") else {}
    while at < len(rows) and rows[at][0] == indent and indent > above - (1 if isinstance(out, list) else 0):
        text = rows[at][1]
        if isinstance(out, list):
            if not text.startswith("-"):
                break
            inner = text[1:].strip()
            head, colon, rest = inner.partition(":")
            if colon and (not rest or rest[0] == " ") and " " not in head:
                rows[at] = (indent + 2, inner)
                value, at = _block(rows, at, indent)
            else:
                value, at = _continued(rows, at, inner, indent)
            out.append(value)
            continue
        if text.startswith("-"):
            break
        key, _, rest = text.partition(":")
        rest = rest.strip()
        if rest:
            out[key.strip()], at = _continued(rows, at, rest, indent)
        else:
            at += 1
            deeper = at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("-")))
            out[key.strip()], at = _block(rows, at, indent) if deeper else (None, at)
    return out, at


def _continued(rows: list[tuple[int, str]], at: int, first: str, indent: int) -> tuple[Any, int]:
    parts, at = [first], at + 1
    while at < len(rows) and rows[at][0] > indent and not _is_item(rows[at][1]):
        parts.append(rows[at][1])
        at += 1
    return _scalar(" ".join(parts)), at


def write_yaml(value: Any, indent: int = 0) -> str:
    pad, out = " " * indent, []
    if isinstance(value, dict):
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            out.append(f"{pad}{k}:" + (f"\n{write_yaml(v, indent + 2)}" if nested else f" {'[]' if v == [] else '{}' if v == {} else _quote(v)}"))
    else:
        for v in value:
            if isinstance(v, dict):
                inner = write_yaml(v, indent + 2)
                out.append(f"{pad}- {inner.lstrip()}")
            else:
                out.append(f"{pad}- {_quote(v)}")
    return "\n".join(out)


def _fill(kind: type, raw: dict[str, Any] | None) -> Any:
    known = {k: v for k, v in (raw or {}).items() if k in kind.__dataclass_fields__}
    return kind(**known)


def load_config(path: str, env_key: str = "LOREBASE_API_KEY") -> Config:
    """The file's values over the defaults; the key of a model service may come from the
    environment. A missing file gives the defaults."""
    raw = read_yaml(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None
    raw = raw or {}
    plain = {k: v for k, v in raw.items() if k in ("db_path", "pdf_dir", "sota_dir")}
    # older files call the place of the vectors after the store that they used
    vectors = [v for k, v in raw.items() if k.endswith("_path") and k != "db_path"]
    plain |= {"vector_path": raw.get("vector_path", vectors[0])} if vectors else {}
    config = Config(
        [_fill(Topic, {**t, "categories": t.get("categories") or [], "research_profile": t.get("research_profile") or ""}) for t in raw.get("topics") or []],
        _fill(Models, raw.get("llm")), _fill(Scraper, raw.get("scraper")), _fill(Filter, raw.get("filter")), **plain,
    )
    config.llm.api_key = os.environ.get(env_key, config.llm.api_key)
    return config


def save_onboarding(path: str, profile: str, topics: list[dict[str, Any]], threshold: int) -> dict[str, Any]:
    """Replaces the topics and the threshold in a configuration file; what else it says stays.

    A topic's query gets its categories unless it names some. A borderline that isn't set is two
    below the threshold, at 2 at least.
    """
    from lorebase.functions.query_language import with_categories

    p = Path(path)
    raw = (read_yaml(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}
    raw["topics"] = [
        {"name": t["name"], "query": with_categories(t["query"], t.get("categories") or [], True), "categories": t.get("categories") or [], "research_profile": profile}
        for t in topics
    ]
    kept = raw.setdefault("filter", {})
    kept["relevance_threshold"] = threshold
    kept.setdefault("borderline_min", max(threshold - 2, 2))
    for k, v in asdict(Config()).items():
        if k not in ("topics", "filter"):
            if isinstance(v, dict):
                v.pop("api_key", None)
            raw.setdefault(k, v)
    p.write_text(write_yaml(raw) + "\n", encoding="utf-8")
    return raw


def topics_frame(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(t.name, t.query, t.categories, t.research_profile) for t in config.topics], schema("topics"))
