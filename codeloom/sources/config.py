"""The configuration of an index: a TOML file found upwards from the indexed folder."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from codeloom.functions.columns import LANGUAGES
from codeloom.plans.page import DEFAULT_BUDGET

FILE = ".codeloom.toml"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    extra_ignore: tuple[str, ...] = ()
    respect_gitignore: bool = True
    macro_strip: tuple[str, ...] = ()
    macro_strip_with_args: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    #: extension -> language, beyond the built-in ones
    extensions: dict[str, str] = field(default_factory=dict)
    max_bytes: int = DEFAULT_BUDGET


def parse_config(text: str) -> Config:
    """Sections discovery, cpp, extensions and response; empty entries drop out, contradictions are errors."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error)) from error
    cpp, discovery = data.get("cpp", {}), data.get("discovery", {})
    strip = tuple(x for x in cpp.get("macro_strip", []) if x)
    with_args = tuple(dict.fromkeys(x for x in cpp.get("macro_strip_with_args", []) if x))
    if both := set(strip) & set(with_args):
        raise ConfigError(f"macro in both strip lists: {min(both)}")
    given = data.get("extensions", {})
    added: dict[str, str] = {}
    for name in ("disabled", *LANGUAGES):
        for extension in given.get(name, []):
            if extension and not extension.startswith("."):
                raise ConfigError(f"extension without a dot in [extensions].{name}: {extension}")
            if extension and name != "disabled" and added.setdefault(extension.lower(), name) != name:
                raise ConfigError(f"extension given to {added[extension.lower()]} and {name}: {extension}")
    size = data.get("response", {}).get("max_bytes", DEFAULT_BUDGET)
    if not isinstance(size, int) or size <= 0:
        raise ConfigError("[response].max_bytes must be positive")
    return Config(tuple(discovery.get("extra_ignore", [])), discovery.get("respect_gitignore", True), strip, with_args, tuple(x.lower() for x in given.get("disabled", []) if x), added, size)


def find_config(start: str, file: str = FILE) -> tuple[Config, str]:
    """The first configuration file at or above ``start`` and its folder; the defaults and ``start`` itself without one."""
    folder = os.path.realpath(start)
    while True:
        path = os.path.join(folder, file)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as held:
                return parse_config(held.read()), folder
        if os.path.dirname(folder) == folder:
            return Config(), os.path.realpath(start)
        folder = os.path.dirname(folder)
