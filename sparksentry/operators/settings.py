"""What the request cascade is run with: read from a JSON or YAML file and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from .ratelimit import Limits

# Keys that a file must have.
REQUIRED = ["listen_host", "listen_port", "backend_url"]
POLICIES = ("any", "majority", "all")


@dataclass(frozen=True)
class Settings:
    """models: names of detectors, in the order in which a verdict names them."""

    models: tuple[str, ...] = ("signature_baseline",)
    voting_policy: str = "any"
    trusted_proxies: tuple[str, ...] = ()
    static_allow_ips: tuple[str, ...] = ()
    static_deny_ips: tuple[str, ...] = ()
    allow_websocket_paths: tuple[str, ...] = ()
    admin_allowed_ips: tuple[str, ...] = ("127.0.0.1", "::1")
    max_request_size_bytes: int = 10 * 1024 * 1024
    limits: Limits = Limits()

    def __post_init__(self) -> None:
        if not self.models:
            raise ValueError("models is empty: at least one detector is needed")
        if self.voting_policy not in POLICIES:
            raise ValueError(f"unknown voting_policy {self.voting_policy!r}; known are {POLICIES}")


def read(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load_settings(path: str) -> Settings:
    """FileNotFoundError without the file, ValueError for missing keys, missing TLS files, no models or an unknown policy."""
    found = read(path)
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"{path} lacks {missing}")
    tls = found.get("tls") or {}
    if tls.get("enabled") and (gone := [k for k in ("certfile", "keyfile") if not Path(tls.get(k) or "/nowhere").is_file()]):
        raise ValueError(f"tls is enabled but the files of {gone} don't exist")
    if not found.get("models"):
        raise ValueError(f"models is empty in {path}: at least one detector is needed")
    rate, default = found.get("rate_limit") or {}, Limits()
    limits = Limits(rate.get("offense_window_seconds", default.window), rate.get("offense_threshold", default.threshold), rate.get("ban_duration_seconds", default.ban))
    lists = {k: tuple(found[k]) for k in ("models", "trusted_proxies", "static_allow_ips", "static_deny_ips", "allow_websocket_paths", "admin_allowed_ips") if found.get(k) is not None}
    others = {k: found[k] for k in ("voting_policy", "max_request_size_bytes") if k in found}
    return Settings(**lists, **others, limits=limits)
