"""Configuration: environment references, clamped model parameters."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from importlib import resources
from pathlib import Path

_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def resolve_env(value, env: dict[str, str] | None = None):
    """``${NAME}`` in texts, lists and objects, however deep; unknown names are empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _REFERENCE.sub(lambda m: env.get(m[1], ""), value)
    if isinstance(value, list):
        return [resolve_env(v, env) for v in value]
    if isinstance(value, dict):
        return {k: resolve_env(v, env) for k, v in value.items()}
    return value


def load_config(variable: str, name: str, package: str | None = None, fallback: str | Path | None = None, root: str | Path = ".", parse: Callable[[str], object] = json.loads, env: dict[str, str] | None = None) -> dict:
    """A configuration file, with environment references resolved.

    The file that the environment variable names wins (a relative one lies below ``root``; one
    that is not there is an error), then the file ``name`` of the package, then that of the
    folder ``fallback``. An empty file is an empty configuration. ``parse``: JSON by default;
    a YAML reader where one is installed.
    """
    env = os.environ if env is None else env
    given = env.get(variable)
    text = None
    if given:
        path = Path(given).expanduser()
        path = path if path.is_absolute() else Path(root) / path
        if not path.exists():
            raise FileNotFoundError(f"no configuration at {path}")
        text = path.read_text(encoding="utf-8")
    if text is None and package:
        try:
            held = resources.files(package).joinpath(name)
            text = held.read_text(encoding="utf-8") if held.is_file() else None
        except ModuleNotFoundError:
            text = None
    if text is None:
        if fallback is None:
            raise FileNotFoundError(f"no configuration {name}")
        text = (Path(fallback) / name).read_text(encoding="utf-8")
    return resolve_env((parse(text) if text.strip() else None) or {}, env)


# The ranges of a model's parameters.
RANGES = {"max_tokens": (1, None), "temperature": (0.0, 2.0), "frequency_penalty": (0.0, 2.0), "presence_penalty": (0.0, 2.0), "top_p": (0.0, 1.0), "top_k": (0, None)}


def clamp_parameters(given: dict, env: dict[str, str] | None = None, prefix: str = "LLM_") -> dict:
    """Parameters within their ranges; an environment variable of the name wins."""
    env = os.environ if env is None else env
    out = {}
    for name, (low, high) in RANGES.items():
        raw = env.get(prefix + name.upper(), given.get(name))
        if raw is None:
            continue
        value = type(low)(float(raw))
        out[name] = max(low, value if high is None else min(high, value))
    return out
