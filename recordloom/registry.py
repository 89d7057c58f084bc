"""Where the engine keeps its files, and the registry of Protocol Buffers schemas."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from .codecs import protobuf
from .errors import IllegalState, ProtobufError

#: Overrides the per-user folders with config, cache and data below one folder.
HOME_VARIABLE = "RECORDLOOM_HOME"
NAME = "recordloom"


class Paths:
    """Folders for configuration, cache and data."""

    def __init__(self, home: str | None = None, env: dict | None = None):
        env = os.environ if env is None else env
        home = home or env.get(HOME_VARIABLE)
        if home:
            self.config, self.cache, self.data = (Path(home) / x for x in ("config", "cache", "data"))
            return
        user = env.get("HOME")
        if not user:
            raise IllegalState("no home directory")
        for name, variable, default in (("config", "XDG_CONFIG_HOME", ".config"), ("cache", "XDG_CACHE_HOME", ".cache"), ("data", "XDG_DATA_HOME", ".local/share")):
            setattr(self, name, Path(env.get(variable) or Path(user) / default) / NAME)

    def preferred_config(self, path: str) -> Path:
        return self.config / path

    def preferred_cache(self, path: str) -> Path:
        return self.cache / path

    def preferred_data(self, path: str) -> Path:
        return self.data / path

    def find_config(self, pattern: str) -> list[Path]:
        return sorted(self.config.glob(pattern))

    def find_data(self, pattern: str) -> list[Path]:
        return sorted(self.data.glob(pattern))


def add_file(paths: Paths, file: str, base: str = ".") -> Path:
    """Copies a .proto file below the data folder, under its path relative to base; from outside base under its bare name."""
    source = Path(file)
    try:
        relative = source.resolve().relative_to(Path(base).resolve())
    except ValueError:
        relative = Path(source.name)
    target = paths.preferred_data("proto") / relative
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    return target


def is_cache_stale(paths: Paths) -> bool:
    """Whether a file was added, edited or deleted since the descriptors were compiled."""
    cache, seen = paths.preferred_cache("descriptors.pb"), paths.preferred_cache("descriptors.json")
    return not cache.exists() or not seen.exists() or json.loads(seen.read_text()) != _state(paths)


def _state(paths: Paths) -> list:
    return [[str(p), p.stat().st_mtime_ns, p.stat().st_size] for p in paths.find_data("proto/**/*.proto")]


def compile_descriptor_set(paths: Paths) -> protobuf.Descriptors:
    """The message types of all added files; compiled once and cached until a file changes."""
    cache = paths.preferred_cache("descriptors.pb")
    if is_cache_stale(paths):
        root, state = paths.preferred_data("proto"), _state(paths)
        try:
            files = [protobuf.ProtoParser(p.read_text(), p.relative_to(root).as_posix()).parse() for p in paths.find_data("proto/**/*.proto")]
            data = protobuf.link(files).SerializeToString()
        except (UnicodeDecodeError, ValueError) as e:
            raise ProtobufError(str(e)) from e
        cache.parent.mkdir(parents=True, exist_ok=True)
        aside = cache.with_suffix(f".{os.getpid()}")
        aside.write_bytes(data)
        aside.replace(cache)
        paths.preferred_cache("descriptors.json").write_text(json.dumps(state))
    return protobuf.Descriptors(cache.read_bytes())
